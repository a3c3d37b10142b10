"""BPE encoding and decoding by per-prefix dynamic programming.

The encoding of every prefix of a word has one last token. A token t that ends at prefix i is that token exactly if the
pair (last token of the prefix before t, t) is compatible, that is, if encoding the two tokens' symbols again gives the
same two tokens. An automaton with suffix links yields the vocabulary's tokens that end at each prefix, longest first;
the first compatible one is stored, and following the stored tokens back from the end emits the exact ids.

Null texts are empty texts; an empty text has no ids and decodes to "". Very long words cost time in proportion to their
length and are not cached. Equal texts give equal rows; further columns are kept, but one of an output's name is replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from groundline.llm import kernels as K
from groundline.llm.tables import read

#: Fixed value: the vocabulary's name for the end of a word.
WORD_END = "</w>"
#: Stands for the end of a word while matching; a private-use code point that the byte alphabet does not contain.
MARK = ""
#: Code points with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: Entries of a worker's caches; a full cache is emptied. Bounds memory, never results.
CACHE = 1_000_000
#: Bytes of text that are encoded at a time: larger blocks have fewer distinct pre-tokens a byte.
TEXT_BLOCK = 2 << 20
LONGEST_CACHED = 48


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stays, others follow from U+0100 in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class PrefixBPE:
    """A word-end BPE vocabulary file of the tokenizers library, encoded as that library does without special tokens."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.bytes = byte_alphabet()
        self.to_byte = {c: b for b, c in enumerate(self.bytes)}
        self.symbols: dict[int, str] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            key = token[: -len(WORD_END)] + MARK if token.endswith(WORD_END) else token
            self.symbols[i] = key
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        self.length = [len(self.symbols.get(i, "")) for i in range(max(self.symbols) + 1)]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = Tokenizer.from_file(path)
        # the file's pattern for lower-cased Latin-1, where the classes are short and no normal form changes a text
        self.latin_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa00-9a-z\xaa\xb5\xba\xb2\xb3\xb9\xbc-\xbe\xdf-\xf6\xf8-\xff]+").findall
        self.white = re.compile(f"[{WHITE}]+").split
        self.parts: dict[str, tuple[str, str]] = {}
        for (a, b), r in self.rank.items():
            if max(self.rank.get(self.parts.get(x, ("", "")), -1) for x in (a, b)) >= r or a + b in self.parts:
                raise ValueError("merges must build each token once, from tokens of earlier merges")
            self.parts[a + b] = (a, b)
        self.spines: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        self.pair: dict[int, bool] = {}  # by left << 17 | right
        self.piece_ids: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, for the few symbols of a pair of tokens."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: self.rank.get((symbols[k], symbols[k + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at a token's left (0) or right (1) edge while it grows: (symbols, rank of the merge that ends this)."""
        if (known := self.spines[side].get(token)) is None:
            known, until, at = [], 1 << 60, token
            while True:
                known.append((at, until))
                if (parts := self.parts.get(at)) is None:
                    break
                until = self.rank[parts]
                at = parts[side]
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether left (-1: none) and right stay apart and whole when their symbols are encoded again.

        A merge crosses the border if its two parts stand at the border when its turn comes. At equal ranks the leftmost
        pair goes first.
        """
        if left < 0:
            if (found := self.whole.get(right)) is None:
                symbols = list(self.symbols[right])
                if symbols[-1] == MARK:
                    symbols[-2:] = [symbols[-2] + WORD_END]
                found = self.whole[right] = self.pair[left << 17 | right] = self.merged(symbols) == [self.names[right]]
            return found
        found = self.compatible(-1, right)
        if found:
            rank, starts = self.rank, self.spine(self.names[right], 0)
            for a, until_a in self.spine(self.names[left], 1):
                for b, until_b in starts:
                    if (m := rank.get((a, b))) is not None and m < until_a and m <= until_b:
                        found = False
                        break
                if not found:
                    break
        if len(self.pair) >= 2 * CACHE:
            self.pair.clear()
        self.pair[left << 17 | right] = found
        return found

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if (ids := self.piece_ids.get(piece)) is not None:
            return ids
        word = (piece if piece.isascii() and piece.isprintable() else "".join([self.bytes[b] for b in piece.encode()])) + MARK
        n, known, length = len(word), self.pair, self.length
        last = [-1] * (n + 1)  # by prefix: its last token
        last[n - 1] = 0  # the word without its end is no prefix to look at
        for end, token in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = last[end + 1 - length[token]]
                if (fits := known.get(before << 17 | token)) is None:
                    fits = self.compatible(before, token)
                if fits:
                    last[end + 1] = token
        at = n
        out = []
        while at:
            if (token := last[at]) < 0:
                raise ValueError(f"no token ends at prefix {at} of {piece!r}")
            out.append(token)
            at -= length[token]
        ids = tuple(out[::-1])
        if n <= LONGEST_CACHED:
            if len(self.piece_ids) >= CACHE:
                self.piece_ids.clear()
            self.piece_ids[piece] = ids
        return ids

    def word(self, word: str) -> list[int]:
        """Ids of text without white space."""
        if self.special and "<" in word:
            parts = self.special.split(word)
            if len(parts) > 1:
                return [i for p in parts for i in ([self.added[p]] if p in self.added else self.word(p) if p else [])]
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:  # the library's own tables of code points; what it cuts is in the byte alphabet
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
            return [i for p, _ in cut for i in self.piece(bytes([self.to_byte[c] for c in p]).decode())]
        return [i for p in self.latin_pieces(word.lower()) for i in self.piece(p)]

    def words(self, text: str) -> list[str]:
        """White-space-separated parts of a text: no pre-token reaches over white space."""
        words = text.split()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            words = [w for w in self.white(text) if w]  # str.split also cuts at these four
        return words

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: the library then joins the tokens by a space."""
        return " ".join([self.names[i] for i in ids])


_loaded: dict[str, PrefixBPE] = {}


def load(path: str) -> PrefixBPE:
    if path not in _loaded:
        _loaded[path] = PrefixBPE(path)
    return _loaded[path]


WHITE_SPACE, LETTER, DIGIT, OTHER = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each ASCII byte, and of each byte that follows 0xC2 and 0xC3 in UTF-8."""
    ascii_, c2, c3 = (np.full(256, OTHER, np.uint8) for _ in range(3))
    ascii_[[*range(9, 14), 32]] = WHITE_SPACE
    ascii_[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    ascii_[0x30:0x3A] = DIGIT
    c2[[0x85, 0xA0]] = WHITE_SPACE
    c2[[0xAA, 0xB5, 0xBA]] = LETTER
    c2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
    c3[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = LETTER
    return ascii_, c2, c3


_ASCII, _C2, _C3 = _kinds()


def split_pieces(data: np.ndarray, offsets: np.ndarray, special: bytes = b"<|") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, cuts): a block's texts, lower-cased, cut into pre-tokens and runs of white space, without a gap.

    Works on bytes, for Latin-1 text. A word with other letters, an apostrophe or the start of a special token stays whole
    and as written: ``PrefixBPE.word`` cuts it.
    """
    n = len(data)
    low, kind = K.LOWER[data], _ASCII[data]
    hard = data == 0x27
    if special:
        here = data == special[0]
        for k, b in enumerate(special[1:], 1):
            here[:-k] &= data[k:] == b
            here[-k:] = False
        hard |= here
    if (data >= 0x80).any():
        hard |= data >= 0xC4
        for lead, table in ((0xC2, _C2), (0xC3, _C3)):
            at = np.flatnonzero(data == lead)
            after = data[at + 1]
            kind[at] = kind[at + 1] = table[after]
            if lead == 0xC3:
                up = at[(after < 0x9F) & (after != 0x97)]
                low[up + 1] = data[up + 1] + 0x20
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= (kind == DIGIT) & K.code_point_starts(data)
    edge = offsets[offsets < n]
    begin[edge] = True
    if hard.any():
        word = kind != WHITE_SPACE
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[edge] |= word[edge]
        starts = np.flatnonzero(first)
        stop = np.append(~word[1:], True)
        stop[edge[edge > 0] - 1] = True
        ends = np.flatnonzero(word & stop) + 1
        which = np.unique(np.searchsorted(starts, np.flatnonzero(hard), "right") - 1)
        step = np.zeros(n + 1, np.int8)
        step[starts[which]] += 1
        step[ends[which]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        low = np.where(inside, data, low)
        begin &= ~inside
        begin[starts[which]] = True
    return low, np.append(np.flatnonzero(begin), n)


class PieceTable:
    """Ids of pre-tokens in flat arrays, found by a sorted array of hashes; what is found is compared byte by byte.

    Holds at most CACHE short pre-tokens; a full table is emptied. Bounds memory, never results.
    """

    def __init__(self, make: Callable[[str], list[int]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, K.U), np.zeros(0, np.int64)
        self.body, self.body_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if it is not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slot = np.where(self.hashes[place] == hashes, self.slots[place], -1)
        size = np.diff(at)
        slot[(slot >= 0) & (np.diff(self.body_at)[slot] != size)] = -1
        rows = np.flatnonzero(slot >= 0)
        mine, theirs = gather(at[rows], size[rows]), gather(self.body_at[slot[rows]], size[rows])
        wrong = np.flatnonzero(body[mine] != self.body[theirs])
        if len(wrong):
            slot[rows[np.searchsorted(np.cumsum(size[rows]), wrong, "right")]] = -1
        return slot

    def __call__(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces body[at[k]:at[k + 1]], where each one's begin and the end)."""
        hashes = K.span_hash(K.prefix_hash(body), at[:-1], at[1:])
        slot = self._find(hashes, body, at)
        known = slot >= 0
        size = np.zeros(len(slot), np.int64)
        size[known] = np.diff(self.ids_at)[slot[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids[gather(self.ids_at[slot], size)], np.append(0, np.cumsum(size))
        made = [self.make(body[a:b].tobytes().decode()) for a, b in zip(at[new].tolist(), at[new + 1].tolist(), strict=True)]
        size[new] = list(map(len, made))
        fresh = np.fromiter(itertools.chain.from_iterable(made), np.int32, int(size[new].sum()))
        starts = np.append(0, np.cumsum(size))
        out = np.empty(starts[-1], np.int32)
        out[gather(starts[:-1][known], size[known])] = self.ids[gather(self.ids_at[slot[known]], size[known])]
        out[gather(starts[new], size[new])] = fresh
        self._keep(hashes, body, at, out, starts, new[np.diff(at)[new] <= LONGEST_CACHED])
        return out, starts

    def _keep(self, hashes: np.ndarray, body: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, new: np.ndarray) -> None:
        if len(self.hashes) + len(new) > CACHE:
            self.clear()
        n = len(self.body_at) - 1
        length, size = np.diff(at)[new], np.diff(starts)[new]
        self.body = np.concatenate([self.body, body[gather(at[new], length)]])
        self.body_at = np.concatenate([self.body_at, self.body_at[-1] + np.cumsum(length)])
        self.ids = np.concatenate([self.ids, ids[gather(starts[new], size)]])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum(size)])
        slots = np.concatenate([self.slots, n + np.arange(len(new))])
        both = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(both, kind="stable")
        self.hashes, self.slots = both[order], slots[order]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class BlockEncoder:
    """Encodes blocks of texts: each distinct pre-token of a block is looked up once, its ids are gathered by index."""

    def __init__(self, path: str):
        self.bpe = load(path)
        common = os.path.commonprefix(list(self.bpe.added)).encode() if self.bpe.added else b""
        self.whole = bool(self.bpe.added) and not common  # special tokens without a common start: texts go one by one
        self.special = common[:2]
        self.table = PieceTable(self.bpe.word)
        size = max(self.bpe.names) + 1
        self.id_words = pa.array([f"{i} " for i in range(size)], pa.large_string())
        self.name_words = pa.array([f"{self.bpe.names.get(i, '')} " for i in range(size)], pa.large_string())

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the end)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.whole:
            texts = [self.bpe.encode(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([i for t in texts for i in t], np.int32), np.cumsum([0, *map(len, texts)])
        low, cuts = split_pieces(data, offsets, self.special)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(low)]).dictionary_encode()
        flat, starts = self.table(*K.utf8(pieces.dictionary))
        which = pieces.indices.to_numpy()
        count = np.diff(starts)[which]
        return flat[gather(starts[which], count)], np.append(0, np.cumsum(count))[np.searchsorted(cuts, offsets)]

    def joined(self, ids: np.ndarray, starts: np.ndarray, words: pa.Array) -> list[memoryview]:
        """For each text its ids' words, joined by one space."""
        taken = words.take(pa.array(ids))
        where = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        body = memoryview(taken.buffers()[2] or b"")
        at = where[starts]
        return [body[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(path: str) -> BlockEncoder:
    """A worker's encoder, kept over its tasks."""
    return K.worker_cache(f"bpe {path}", lambda: BlockEncoder(path))


def _with(df: DataFrame, out: str) -> DataFrame:
    """df without a column of the output's name, which is replaced."""
    return df.drop(*[c for c in df.columns if c.lower() == out.lower()])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of df and the ids of each text, as an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_block = encoder(path)
        for batch in batches:
            for part, data, offsets in K.blocks(batch, text, TEXT_BLOCK):
                ids, starts = encode_block(data, offsets)
                yield part.append_column(out, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)))

    df = _with(df, out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of df and the text that the ids stand for; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield batch.append_column(out, pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string()))

    df = _with(df, out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded in one pass.

    A document's ids never leave the worker. What ``decode`` gives is the tokens' names joined by a space.
    """
    fields = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_block = encoder(path)
        for batch in batches:
            for part, data, offsets in K.blocks(batch, text, TEXT_BLOCK):
                ids, starts = encode_block(data, offsets)
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in encode_block.joined(ids, starts, words)], pa.string()) for words in (encode_block.id_words, encode_block.name_words)]
                yield pa.record_batch([part.column(key), pa.array(np.diff(starts)), *digests], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, fields)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read(spark, sf_dir, "documents"), tokenizer_path())

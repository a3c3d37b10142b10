"""Quality rules: repetition rules, and perplexity bands of modified Kneser-Ney n-gram models by language.

The models' symbols are the bytes of UTF-8 as they are, ORDER of them an n-gram, so the tables grow with the corpus. Spark
counts the n-grams of all documents: blocks of texts send their distinct n-grams, sorted and packed, to shards; a shard
owns all n-grams whose context ends with the same two bytes, so all orders above two follow from what it holds. Orders one
and two and the discounts are small (LANGUAGES models of 256 x 256 numbers at most) and are broadcast. A shard keeps
sorted arrays of n-gram numbers and probabilities, and answers each block with the surprisals of its n-grams. Lower orders
use continuation counts, each order three discounts from its counts of counts. Models and scores use whole texts.

Languages with at least one of LANGUAGES documents have a model of their own, the others share one; bands are by language
in any case. A document's surprisal, in bits a letter of its words (marks count as surprise, not as letters), is compared
with the quartiles of its language, over all documents that pass the base rules. It is rejected outside
[q1 - reach * spread, q3 + reach * spread], where spread is the quartiles' distance but no less than LEAST_SPREAD bits.
A document that fails the base rules is rejected in any case.

Null texts are empty: no words, surprisal 0, base_failed. Null languages are one language of their own. Repeated rows are
judged alike, each with a row of its own. An empty table gives an empty result. Only key, text and lang are read; other
columns may have any name and pass through ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import kernels as K
from groundline.llm.tables import cut, read, settled

ORDER = 5
SYMBOLS = 256
LANGUAGES = 100
LEAST_WORDS = 20
WINDOW = 8
REACH = 5.0
LEAST_SPREAD = 0.02
#: Bytes of text that a block holds, as a rule.
BLOCK_BYTES = 8 << 20
#: Surprisals are ranked in steps of a part of a bit, up to MOST bits.
STEPS, MOST = 1024, 64
#: Fixed value: the symbols that n_symbols counts.
MARKS = b"#*$%&|<>"


def codes(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte the number of the n-gram that ends there; n-grams never reach over the start of their text."""
    symbols = data.astype(np.int64)
    out = symbols.copy()
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        shifted = np.zeros_like(symbols)
        shifted[k:] = symbols[:-k] if k < len(symbols) else 0
        shifted[place < k] = 0
        out += shifted * SYMBOLS**k
    return out


def discounts_of(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discounts of n-grams seen 0, 1, 2 and more times, from how many were seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = np.maximum(counts_of_counts, 1.0)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1, 1, 2, 3])


def continuations(grams: np.ndarray, symbols: int, lengths: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the n-grams that are tails of the given distinct ones, and of how many symbols each is a continuation."""
    tables = []
    for k in lengths:
        grams, n = np.unique(grams % symbols**k, return_counts=True)
        tables.append((grams, n.astype(np.float64)))
    return tables


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([float((n == j).sum()) for j in (1, 2, 3, 4)])


class KneserNey:
    """Interpolated modified Kneser-Ney over n-gram numbers, as sorted arrays of numbers and probabilities.

    ``base``: probabilities of the n-grams of length ``below`` by number; what is shorter than that is not looked up.
    ``discounts``: by length; those that are missing follow from the given n-grams.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, symbols: int = SYMBOLS, order: int = ORDER, base: np.ndarray | None = None, below: int = 0, discounts: dict[int, np.ndarray] | None = None):
        self.symbols, self.order, self.base, self.below = symbols, order, base, below
        order_by = np.argsort(grams)
        tables = [(grams[order_by], counts[order_by].astype(np.float64))]
        tables = [*continuations(tables[0][0], symbols, range(order - 1, below, -1))[::-1], *tables]
        self.hashes: dict[int, np.ndarray] = {}
        self.probabilities: dict[int, np.ndarray] = {}
        self.context_hashes: dict[int, np.ndarray] = {}
        self.back_off: dict[int, np.ndarray] = {}
        for k, (gram, n) in enumerate(tables, below + 1):
            d = discounts[k] if discounts else discounts_of(counts_of_counts(n))
            discount = d[np.minimum(n, 3).astype(np.int64)]
            contexts, at = np.unique(gram // symbols, return_inverse=True)
            total = np.bincount(at, n)
            gamma = np.bincount(at, discount) / total
            lower = self.lookup(k - 1, gram % symbols ** (k - 1))
            self.hashes[k] = gram
            self.probabilities[k] = (n - discount) / total[at] + gamma[at] * lower
            self.context_hashes[k] = contexts
            self.back_off[k] = gamma

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
        return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)

    def lookup(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of length k; an unseen one backs off by its context's weight."""
        if k == self.below:
            return self.base[grams] if k else np.full(len(grams), 1.0 / self.symbols)
        at, known = self._find(self.hashes[k], grams)
        out = np.empty(len(grams))
        out[known] = self.probabilities[k][at[known]]
        if not known.all():
            rest = grams[~known]
            at, seen = self._find(self.context_hashes[k], rest // self.symbols)
            gamma = np.where(seen, self.back_off[k][at] if len(self.back_off[k]) else 1.0, 1.0)
            out[~known] = gamma * self.lookup(k - 1, rest % self.symbols ** (k - 1))
        return out

    def surprisal(self, grams: np.ndarray) -> np.ndarray:
        return -np.log2(self.lookup(self.order, grams))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    n = len(offsets) - 1
    starts, ends, ptr = K.word_spans(data, offsets)
    prefix = K.prefix_hash(data)
    words = K.span_hash(prefix, starts, ends)
    mark = np.zeros(256, bool)
    mark[[*MARKS]] = True
    # lines with a word: cut at \n and at texts' ends
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, offsets]))
    line_start, line_end = cuts[:-1], cuts[1:] - 1
    closed = data[line_end] == 0x0A if len(line_end) else np.zeros(0, bool)
    line_end = np.where(closed, line_end, line_end + 1)
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    lines = K.span_hash(prefix, line_start, line_end)
    line_ptr = np.searchsorted(line_start, offsets)
    dup, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        a, b = line_ptr[i], line_ptr[i + 1]
        if b - a > 1:
            dup[i] = b - a - len(np.unique(lines[a:b]))
        a, b = ptr[i], ptr[i + 1]
        if b - a > WINDOW:
            w = words[a:b]
            grams = np.zeros(b - a - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                grams = grams * K.U(0x9E3779B97F4A7C15) + w[k : k + len(grams)]
            by = np.argsort(grams)
            s = grams[by]
            same = s[1:] == s[:-1]
            if same.any():
                again = np.zeros(len(s), bool)
                again[1:] |= same
                again[:-1] |= same
                step = np.zeros(b - a + 1, np.int64)
                at = by[again]
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
                repeated[i] = int((np.cumsum(step)[:-1] > 0).sum())
    return {
        "n_words": np.diff(ptr).astype(np.int64),
        "word_chars": K.counted(K.code_point_starts(data) & ~K.SPACE[data], offsets),
        "n_symbols": K.counted(mark[data], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


MODEL = SYMBOLS**ORDER
PAIR = SYMBOLS**2


def _pack(x: np.ndarray) -> bytes:
    """Numbers, packed: first the first bytes of all, then the second ones and so on, as high bytes are alike."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(x: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _zip(x: np.ndarray) -> bytes:
    """Sorted numbers, their differences packed."""
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _unzip(x: bytes, kind: type, n: int) -> np.ndarray:
    return np.cumsum(_unpack(x, kind, n), dtype=kind)


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of an n-gram: that of its model and of the last two bytes of its context."""
    return (K.mix((grams // MODEL * PAIR + grams // SYMBOLS % PAIR).astype(K.U)) % K.U(shards)).astype(np.int64)


def _block_grams(batch: pa.RecordBatch, text: str, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, each with its model in front, and how often they stand there."""
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part, data, offsets, rows in _slices(batch, text):
        del part
        found, n = np.unique(codes(data, offsets) + np.repeat(model[rows] * MODEL, np.diff(offsets)), return_counts=True)
        both = np.concatenate([grams, found])
        grams, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(grams)).astype(np.int64)
    return grams, counts


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, slice]]:
    at = 0
    for part, data, offsets in K.blocks(batch, text):
        yield part, data, offsets, slice(at, at + part.num_rows)
        at += part.num_rows


def _models(batch: pa.RecordBatch, lang: str, known: list) -> np.ndarray:
    """The model's number of each row: 1 for the first known language and so on, 0 for all others."""
    number = {x: k for k, x in enumerate(known, 1)}
    column = batch.column(lang).dictionary_encode() if not isinstance(batch.column(lang), pa.DictionaryArray) else batch.column(lang)
    by = np.array([*(number.get(x, 0) for x in column.dictionary.to_pylist()), number.get(None, 0)], np.int64)
    return by[column.indices.fill_null(len(by) - 1).to_numpy(zero_copy_only=False)]


def _blocks(docs: DataFrame, text: str, made: Callable[[int, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` gives for each block of about BLOCK_BYTES of text, by the block's number.

    Blocks follow from the order of rows, so two passes over a table that ``settled`` has given have the same blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        K.forget()
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            offsets = K.utf8(batch.column(batch.schema.get_field_index(text)))[1]
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES - size, "right"))
                to = min(max(at + 1, to), batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                at = to
                if size >= BLOCK_BYTES:
                    yield made(block, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    block, held, size = block + 1, [], 0
        if held:
            yield made(block, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return docs.mapInArrow(run, schema)


def _packed_rows(docs: DataFrame, text: str) -> DataFrame:
    """(block, x): the rows of each block, packed."""

    def made(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            out.write_batch(batch)
        return pa.record_batch([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "x"])

    return _blocks(docs, text, made, "block long, x binary")


def _requests(docs: DataFrame, text: str, lang: str, known: list, shards: int) -> DataFrame:
    """(block, shard, n, x, y): the distinct n-grams of each block and how often they stand there, by shard."""

    def made(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = _block_grams(batch, text, _models(batch, lang, known))
        shard = _shard(grams, shards)
        order = np.argsort(shard, kind="stable")
        grams, counts, shard = grams[order], counts[order], shard[order]
        ends = np.searchsorted(shard, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(ends))
        cuts = [(int(ends[k]), int(ends[k + 1])) for k in used]
        return pa.record_batch([pa.array(np.full(len(used), block)), pa.array(used), pa.array([b - a for a, b in cuts], pa.int64()), pa.array([_zip(grams[a:b]) for a, b in cuts], pa.binary()), pa.array([_pack(counts[a:b]) for a, b in cuts], pa.binary())], names=["block", "shard", "n", "x", "y"])

    return _blocks(docs, text, made, "block long, shard long, n long, x binary, y binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A shard's n-grams, how often they stand in all blocks, and for each block the places of its own."""
    n = table.column("n").to_pylist()
    own = [_unzip(x, np.int64, k) for x, k in zip(table.column("x").to_pylist(), n, strict=True)]
    counts = np.concatenate([_unpack(y, np.int64, k) for y, k in zip(table.column("y").to_pylist(), n, strict=True)])
    grams, back = np.unique(np.concatenate(own), return_inverse=True)
    ends = np.cumsum(n)
    return grams, np.bincount(back, counts), [back[e - k : e] for e, k in zip(ends, n, strict=True)]


def _by_model(grams: np.ndarray) -> Iterator[tuple[int, slice]]:
    model = grams // MODEL
    for m in np.unique(model).tolist():
        yield m, slice(*np.searchsorted(model, [m, m + 1]))


def _low_orders(made: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, dict[int, np.ndarray]]]:
    """By model: the probabilities of two symbols, and the discounts of the longer n-grams.

    The driver gets sums only: for at most LANGUAGES + 1 models 256 x 256 continuation counts and a few counts of counts.
    """

    def stats(table: pa.Table) -> pa.Table:
        grams, counts, _ = _merged(table)
        rows: list[tuple[int, int, int, float]] = []
        for m, at in _by_model(grams):
            tables = [(grams[at], counts[at]), *continuations(grams[at] % MODEL, SYMBOLS, range(ORDER - 1, 1, -1))]
            for k, (_, n) in zip(range(ORDER, 2, -1), tables, strict=False):
                rows += [(m, k, j, c) for j, c in enumerate(counts_of_counts(n).tolist())]
            rows += [(m, 2, g, c) for g, c in zip(tables[-1][0].tolist(), tables[-1][1].tolist(), strict=True)]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([("model", pa.int64()), ("k", pa.int64()), ("g", pa.int64()), ("c", pa.float64())])})

    shards = made.groupBy("shard").applyInArrow(stats, "model long, k long, g long, c double")
    found = shards.groupBy("model", "k", "g").agg(F.sum("c").alias("c")).toArrow()
    model, k, g, c = (found.column(x).to_numpy() for x in ("model", "k", "g", "c"))
    base, discounts = {}, {}
    for m in np.unique(model).tolist():
        discounts[m] = {}
        for length in range(3, ORDER + 1):
            at = (model == m) & (k == length)
            n = np.zeros(4)
            n[g[at]] = c[at]
            discounts[m][length] = discounts_of(n)
        at = (model == m) & (k == 2)
        two = KneserNey(g[at], c[at], SYMBOLS, 2)
        base[m] = two.lookup(2, np.arange(PAIR)).astype(np.float32)
    return base, discounts


def _answers(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, list]:
    """(the surprisals of each block's n-grams, in one shard's order; the languages with models)."""
    spark = docs.sparkSession
    by_lang = docs.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    total = by_lang.agg(F.sum("n")).first()[0] or 0
    known = sorted((r["lang"] for r in by_lang.filter(F.col("n") * LANGUAGES >= total).collect()), key=lambda x: (x is None, x))  # LANGUAGES at most
    made = cut(_requests(docs.select(text, lang), text, lang, known, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    models = spark.sparkContext.broadcast(_low_orders(made))

    def answer(table: pa.Table) -> pa.Table:
        grams, counts, places = _merged(table)
        bits = np.empty(len(grams), np.float32)
        base, discounts = models.value
        for m, at in _by_model(grams):
            model = KneserNey(grams[at] % MODEL, counts[at], SYMBOLS, ORDER, base[m], 2, discounts[m])
            bits[at] = model.surprisal(grams[at] % MODEL)
        return pa.table({"block": table.column("block"), "n": table.column("n"), "grams": table.column("x"), "bits": pa.array([_pack(bits[p]) for p in places], pa.binary())})

    return made.groupBy("shard").applyInArrow(answer, "block long, n long, grams binary, bits binary"), known


class _Surprisals:
    """Surprisals of a block's n-grams; a table of one n-gram a place spares nearly all searches."""

    PLACES = 21

    def __init__(self, grams: np.ndarray, bits: np.ndarray):
        if not len(grams):
            grams, bits = np.array([-1]), np.zeros(1, np.float32)
        order = np.argsort(grams)
        self.grams, self.bits = grams[order], bits[order]
        self.table = np.zeros(1 << self.PLACES, np.int32)
        self.table[self._place(self.grams)] = np.arange(len(grams))

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(K.U) * K.U(0x9E3779B97F4A7C15)) >> K.U(64 - self.PLACES)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.table[self._place(grams)]
        other = np.flatnonzero(self.grams[at] != grams)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.grams, grams[other]), len(self.grams) - 1)
            if (self.grams[at[other]] != grams[other]).any():
                raise RuntimeError("the table has other rows than when its n-grams were counted")
        return self.bits[at]


def _opened(x: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(x).read_all().combine_chunks().to_batches()[0]


def _scored(blocks: DataFrame, answers: DataFrame, docs: DataFrame, key: str, text: str, lang: str, known: list) -> DataFrame:
    """(block, row, key, lang, the base counts, bits) of every row; row is its place in the block."""

    def run(block: pa.Table, table: pa.Table) -> pa.Table:
        batch = _opened(block.column("x")[0].as_py())
        n = table.column("n").to_pylist()
        grams = [_unzip(x, np.int64, k) for x, k in zip(table.column("grams").to_pylist(), n, strict=True)]
        bits = [_unpack(x, np.float32, k) for x, k in zip(table.column("bits").to_pylist(), n, strict=True)]
        bits_of = _Surprisals(np.concatenate([*grams, np.zeros(0, np.int64)]), np.concatenate([*bits, np.zeros(0, np.float32)]))
        model, parts = _models(batch, lang, known), []
        for part, data, offsets, rows in _slices(batch, text):
            counts = base_counts(data, offsets)
            each = bits_of(codes(data, offsets) + np.repeat(model[rows] * MODEL, np.diff(offsets))) if len(data) else np.zeros(0)
            total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            letters = np.maximum(counts["word_chars"] - counts["n_symbols"], 1)
            mean = (total[offsets[1:]] - total[offsets[:-1]]) / letters
            parts.append(pa.table([pa.array(np.full(part.num_rows, block.column("block")[0].as_py())), pa.array(np.arange(rows.start, rows.stop)), part.column(key), part.column(lang).cast(pa.string()), *[pa.array(counts[c]) for c in BASE], pa.array(mean)], names=names))
        K.give_back()
        return pa.concat_tables(parts)

    names = ["block", "row", "key", "lang", *BASE, "bits"]
    long = [T.StructField(c, T.LongType()) for c in BASE]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("lang", T.StringType()), *long, T.StructField("bits", T.DoubleType())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bands(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """(band_lang, low, high): the surprisal that each language admits, from all its documents that pass the base rules.

    Quartiles are exact in steps of 1 / STEPS bit, whatever the partitioning; a language has MOST * STEPS steps at most.
    """
    steps = scored.filter("not base_failed").groupBy("lang", F.least(F.floor(F.col("bits") * STEPS), F.lit(MOST * STEPS)).alias("step")).agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    ranked = steps.withColumn("below", F.sum("n").over(by_lang.orderBy("step"))).withColumn("all", F.sum("n").over(by_lang))
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("step"))) / STEPS
    found = ranked.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    return found.select(F.col("lang").alias("band_lang"), (F.col("q1") - reach * spread).alias("low"), (F.col("q3") + 1 / STEPS + reach * spread).alias("high"))


def _judged(docs: DataFrame, key: str, text: str, lang: str, reach: float) -> DataFrame:
    """(block, row, key, the base counts, base_failed, bits, kept) for every row of docs, which are settled."""
    answers, known = _answers(docs, text, lang)
    blocks = _packed_rows(docs.select(key, text, lang), text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = cut(_scored(blocks, answers, docs, key, text, lang, known).withColumn("base_failed", failed))
    out = scored.join(bands(scored, reach), F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("block", "row", "key", *BASE, "base_failed", "bits", kept.alias("kept"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", reach: float = REACH) -> DataFrame:
    """(key, the base counts, base_failed, bits, kept) for every row of docs."""
    verdict = _judged(settled(docs.select(key, text, lang)), key, text, lang, reach)
    return verdict.select(F.col("key").alias(key), *BASE, "base_failed", "bits", "kept")


def quality_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", reach: float = REACH) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each row is judged by itself, whatever its key.

    A verdict is a place in a block, and blocks are packed again with all columns, so no text is joined by its content.
    """
    docs = settled(docs)
    verdict = _judged(docs, key, text, lang, reach)

    def keep(block: pa.Table, rows: pa.Table) -> pa.Table:
        batch = _opened(block.column("x")[0].as_py())
        return pa.Table.from_batches([batch.take(pa.array(np.sort(rows.column("row").to_numpy())))])

    kept = verdict.filter("kept").select("block", "row")
    return _packed_rows(docs, text).groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(keep, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "bits")

"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are alike by their common subsequences of three letters, weighted by DECAY for every letter they span, gaps
included, and normalised; the third power makes chance likeness small. Sentences are sums over their distinct words, so this is a
convolution kernel. LANDMARKS words, taken from the training sentences (four fifths by how much likelier they are in toxic
documents, the others the most common words), give every sentence its Nystroem features; a linear machine with squared hinge loss is
trained on them. Labels are of documents: in repeated rounds the sentences of a toxic document that look clean are taken
for clean, except its worst. Training sentences are repeated with characters inserted into their words, so gapped insults
score high too. A document's score is its worst sentence's margin, as a probability by a sigmoid fitted on the documents.

The machine is fitted on a bounded sample: at most SAMPLE labelled documents of each class, of at most SAMPLE_CHARS
characters each, dealt by a hash of the id. Everything else covers all documents and whole texts.

Null and empty texts have no sentence and score as an empty sentence does. Words are runs without ASCII white
space; sentences end after words that end with . ! ?, at line ends and after LONGEST words; words longer than SPAN letters are read in overlapping spans. Documents without labels are scored like all
others; labels that are null or of unknown ids are not used; of several labels of an id the highest counts. Without
labels of both classes every score is the share of toxic labels, or 0. Repeated rows get equal rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import kernels as K
from groundline.llm.tables import read

SAMPLE, SAMPLE_CHARS = 1000, 20_000
LANDMARKS = 80
GRAM, DECAY, POWER = 3, 0.9, 3
#: Likeness below this is chance and counts as none.
LEAST = 0.25
LONGEST, SPAN = 40, 24
THRESHOLD = 0.7
#: Words that a worker remembers the share of; a full table is emptied. Bounds memory, never results.
CACHE = 1_000_000
RIDGE = 0.0005
#: Words are runs without ASCII white space.
WORD, WHITE, LINES = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[\n\r]+")
SPACED = re.compile(r"(?<![^\x20\x09-\x0D])\w(?:[\x20\x09-\x0D]\w){2,}(?![^\x20\x09-\x0D])")
NOT_LETTERS = re.compile(r"[\W_]+")


def letters(word: str) -> str:
    return NOT_LETTERS.sub("", word.lower())


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence by their letters; single letters in a row are one word."""
    text = SPACED.sub(lambda m: WHITE.sub("", m[0]), text)
    out, words = [], []
    for line in LINES.split(text):
        for w in WORD.findall(line):
            words.append(letters(w))
            if w[-1] in ".!?":
                out.append(words)
                words = []
        out.append(words)
        words = []
    return [sorted(set(s[i : i + LONGEST]) - {""}) for s in out for i in range(0, len(s), LONGEST)]


def spans(word: str) -> list[str]:
    return [word] if len(word) <= SPAN else [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def subsequence_kernel(words: list[str], marks: list[str], block: int = 512) -> np.ndarray:
    """(words, marks): the sum over common subsequences of GRAM letters of DECAY ** (both spans), unnormalised."""
    out = np.zeros((len(words), len(marks)), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    width = max(map(len, marks), default=0)
    z = np.zeros((width, len(marks)), np.int32)
    for k, m in enumerate(marks):
        z[: len(m), k] = [ord(c) for c in m]
    d, dd = np.float32(DECAY), np.float32(DECAY * DECAY)
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        length = len(words[rows[-1]])
        x = np.full((length, len(rows)), -1, np.int32)
        for k, i in enumerate(rows):
            x[: len(words[i]), k] = [ord(c) for c in words[i]]
        shape = (len(rows), len(marks))
        # below[q][j]: subsequences of q letters in the word so far and the mark's first j letters, decayed to both ends
        below = [np.zeros((width + 1, *shape), np.float32) for _ in range(GRAM)]
        below[0] += 1
        total = np.zeros(shape, np.float32)
        step, run = np.empty((width, *shape), np.float32), np.empty(shape, np.float32)
        for i in range(length):
            same = np.where(x[i][None, :, None] == z[:, None, :], dd, np.float32(0))
            np.multiply(same, below[GRAM - 1][:-1], out=step)  # the last letter, from the state before this letter
            total += step.sum(0)
            for q in range(GRAM - 1, 0, -1):
                np.multiply(same, below[q - 1][:-1], out=step)
                below[q] *= d
                run[:] = 0
                for j in range(width):
                    run *= d
                    run += step[j]
                    below[q][j + 1] += run
        out[rows] = total
    return out


def least_self(n: int) -> float:
    """What the kernel of any word of n letters with itself is at least: each subsequence meets itself."""
    return sum((n - span + 1) * (span - 2) * DECAY ** (2 * span) for span in range(3, n + 1)) if n >= 3 else 0.0


_least = np.array([least_self(n) for n in range(SPAN + 1)])


def alike(words: list[str], marks: list[str], own: np.ndarray) -> np.ndarray:
    """Normalised kernel to the power of POWER; own: the marks' kernel with themselves."""
    found = subsequence_kernel(words, marks) / np.sqrt(np.maximum(own, 1e-12)).astype(np.float32)
    n = np.array([len(w) for w in words], int)
    near = np.flatnonzero((found.max(1) if found.size else np.zeros(len(words))) >= 0.999 * LEAST * np.sqrt(_least[n]))
    out = np.zeros_like(found)
    if len(near):
        part = found[near] / np.sqrt(np.maximum(self_kernels([words[i] for i in near]), 1e-12))[:, None]
        out[near] = np.where(part < LEAST, 0, part) ** POWER
    return out


def self_kernels(words: list[str], block: int = 512) -> np.ndarray:
    """The kernel of each word with itself, many words at a time."""
    out = np.zeros(len(words))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    d, dd = DECAY, DECAY * DECAY
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        n = len(words[rows[-1]])
        x = np.arange(-1, -1 - n * len(rows), -1, dtype=np.int64).reshape(n, len(rows))
        for k, i in enumerate(rows):
            x[: len(words[i]), k] = [ord(c) for c in words[i]]
        below = [np.zeros((n + 1, len(rows))) for _ in range(GRAM)]
        below[0] += 1
        total = np.zeros(len(rows))
        for i in range(n):
            valid = (x[i] >= 0).astype(float)
            same = (x[i][None, :] == x).astype(float) * valid
            total += (same * below[GRAM - 1][:-1]).sum(0) * dd
            for q in range(GRAM - 1, 0, -1):
                run = np.zeros(len(rows))
                step = same * below[q - 1][:-1] * dd
                below[q][1:] *= d
                for j in range(n):
                    run = run * d + step[j]
                    below[q][j + 1] += run
        out[rows] = total
    return out


@dataclass(frozen=True)
class Machine:
    """A trained machine; words' shares of a margin add up, so a worker keeps one number a word."""

    marks: list[str]
    own: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def shares(self, words: list[str]) -> np.ndarray:
        """Each word's share of its sentence's margin; words are given by their letters."""
        parts = [(i, s) for i, w in enumerate(words) for s in spans(w) if len(s) >= GRAM]
        out = np.zeros(len(words))
        if parts and self.marks:
            got = np.concatenate([alike([s for _, s in parts[k : k + 20_000]], self.marks, self.own) @ self.weights for k in range(0, len(parts), 20_000)])
            np.add.at(out, [i for i, _ in parts], got)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def hinge_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, strip: int = 4096) -> np.ndarray:
    """Weights of the squared-hinge machine by Newton steps, the last one the constant's; rows are added up in strips."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        left, right = np.diag(penalty), np.zeros(n)
        for a in range(0, len(x), strip):
            part = np.append(x[a : a + strip], np.ones((len(x[a : a + strip]), 1)), 1).astype(float)
            inside = y[a : a + strip] * (part @ w) < 1
            part, of = part[inside], weight[a : a + strip][inside, None]
            left += (part * of).T @ part
            right += (part * of).T @ y[a : a + strip][inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability by Newton steps, with smoothed targets so that a clean split stays finite."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    # both classes weigh the same: the threshold then stands for evidence, not for how rare toxic documents are
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * (n0 + n1)
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Machine:
    """A machine from documents and their labels; the lists are the bounded sample."""
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return Machine([], np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # equal words are one string
    docs = [[[one.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    seen = [Counter(), Counter()]
    for d, label in zip(docs, y, strict=True):
        seen[label].update({w for s in d for w in map(letters, s) if GRAM < len(w) <= SPAN})
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    few = max(2, n[1] // 200)
    odds = {w: np.log(((k + 0.5) / (n[1] + 1)) / ((seen[0][w] + 0.5) / (n[0] + 1))) * (k / n[1]) for w, k in seen[1].items() if k >= few}
    marks = sorted((w for w in odds if odds[w] > 0), key=lambda w: (-odds[w], w))[: 4 * LANDMARKS // 5]
    marks += [w for w, _ in sorted((seen[0] + seen[1]).items(), key=lambda x: (-x[1], x[0])) if w not in marks][: LANDMARKS - len(marks)]
    own = self_kernels(marks)
    gram = alike(marks, marks, own).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T

    def inserted(word: str) -> str:
        w = letters(word)
        return w[: (k := int(rng.integers(1, len(w) - 1)))] + "aeioxrst"[int(rng.integers(8))] + w[k:] if 3 < len(w) < SPAN else w

    rows = [(i, s) for i, d in enumerate(docs) for s in d]
    first = np.array([sum(max(0.0, odds.get(letters(w), 0.0)) for w in s) for _, s in rows])
    # of a toxic document the likeliest sentence is there once more, with inserted characters
    likeliest: dict[int, int] = {}
    for r, (i, _) in enumerate(rows):
        if y[i] and first[r] > first[likeliest.setdefault(i, r)]:
            likeliest[i] = r
    rows += [(len(docs) + i, [inserted(w) for w in rows[r][1]]) for i, r in likeliest.items()]
    words = sorted({x for _, s in rows for w in s for x in spans(letters(w)) if len(x) >= GRAM})
    number = {w: k for k, w in enumerate(words)}
    features = np.concatenate([alike(words[k : k + 20_000], marks, own) for k in range(0, len(words), 20_000)])
    x = np.zeros((len(rows) + 1, len(marks)), np.float32)  # the last row is a sentence without words
    turn = root.astype(np.float32)
    for r, (_, s) in enumerate(rows):
        at = [number[p] for w in s for p in spans(letters(w)) if len(p) >= GRAM]
        if at:
            x[r] = features[at].sum(0) @ turn
    del features
    bag = np.array([i for i, _ in rows])
    toxic_bag = np.concatenate([y, y])[bag] > 0
    label = np.where(toxic_bag & (bag >= len(docs)), 1.0, -1.0)
    label[list(likeliest.values())] = 1.0
    worst = np.full(2 * len(docs), -np.inf)
    for _ in range(8):
        weight = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label < 0).sum())) * len(label)
        # a sentence without words is clean, whatever else the machine learns
        w = hinge_machine(x, np.append(label, -1.0), np.append(weight, 0.25 * len(label)), RIDGE * len(label))
        margin = x[:-1] @ w[:-1] + w[-1]
        worst[:] = -np.inf
        np.maximum.at(worst, bag, margin)
        new = np.where(toxic_bag & ((margin > 0) | (margin >= worst[bag])), 1.0, -1.0)
        if (new == label).all():
            break
        label = new
    there = np.isfinite(worst) | (np.arange(2 * len(docs)) < len(docs))
    worst = np.where(np.isfinite(worst), worst, w[-1])
    slope, shift = sigmoid_fit(worst[there], np.tile(np.where(y > 0, 1, -1), 2)[there])
    weights = root @ w[:-1]
    used = np.flatnonzero(np.abs(weights) > 0.01 * np.abs(weights).max())
    return Machine([marks[k] for k in used], own[used], weights[used].astype(np.float32), float(w[-1]), slope, shift)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of the training sample, never of held-out ids."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = []
    for c in (0, 1):
        chosen += [(r[0], c) for r in known.filter(F.col("y") == c).orderBy(F.xxhash64(key), key).limit(2 * SAMPLE).select(key).collect()]
    if not chosen:
        return [], []
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, T.StructType([T.StructField("id", labels.schema[key].dataType), T.StructField("y", T.IntegerType())]))
    short = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col(key).alias("id"), F.col(text).alias("t"))
    found = short.join(F.broadcast(ids), "id")  # at most 4 * SAMPLE rows
    rows = []
    for c in (0, 1):
        rows += found.filter(F.col("y") == c).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    return [r["t"] for r in rows], [r["y"] for r in rows]


class Table:
    """Columns of numbers by the hash of a word, in sorted arrays."""

    def __init__(self, *kinds: type):
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.hashes, self.columns = np.zeros(0, K.U), [np.zeros(0, k) for k in self.kinds]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(which hashes are known, each column's values); values of unknown ones are any."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), *[np.zeros(len(hashes), k) for k in self.kinds]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, *[c[at] for c in self.columns]

    def add(self, hashes: np.ndarray, *columns: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > CACHE:
            self.clear()
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.columns = both[order], [np.concatenate([old, new])[order] for old, new in zip(self.columns, columns, strict=True)]


def hash_words(words: list[str]) -> np.ndarray:
    body, at = K.utf8(pa.array(words, pa.string()))
    return K.span_hash(K.prefix_hash(body), at[:-1], at[1:])


class Scorer:
    """Scores of texts with one machine; the shares of words it has met are kept over a worker's tasks.

    A word as written has a share, the hash of its letters and whether it is a single letter; a second table has the
    shares by letters.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.written, self.by_letters = Table(float, K.U, bool), Table(float)

    def shares(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shares, hashes) of words given by their letters."""
        hashes = hash_words(words)
        known, values = self.by_letters.find(hashes)
        new, first = np.unique(hashes[~known], return_index=True)
        if len(new):
            at = np.flatnonzero(~known)[first]
            found = self.machine.shares([words[i] for i in at])
            self.by_letters.add(new, found)
            values[~known] = found[np.searchsorted(new, hashes[~known])]
        return values, hashes

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The margin of each text's worst sentence."""
        out = np.full(len(offsets) - 1, self.machine.bias)
        start, end, ptr = K.word_spans(data, offsets)
        if not len(start):
            return out
        text = np.repeat(np.arange(len(out)), np.diff(ptr))
        distinct, first, back = np.unique(K.span_hash(K.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        known, share, name, single = self.written.find(distinct)
        new = np.flatnonzero(~known)
        if len(new):
            words = [data[a:b].tobytes().decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            share[new], name[new] = self.shares([letters(w) for w in words])
            single[new] = [len(w) == 1 and (w.isalnum() or w == "_") for w in words]
            self.written.add(distinct[new], share[new], name[new], single[new])
        share, name, text, start, end = self._joined(data, single[back], share[back], name[back], text, start, end)
        # sentences: a new one at a text's first word, after . ! ? and after a line end, and after LONGEST words
        lines = np.append(0, np.cumsum((data == 0x0A) | (data == 0x0D)))
        fresh = np.ones(len(start), bool)
        stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8))
        fresh[1:] = (text[1:] != text[:-1]) | stop[:-1] | (lines[start[1:]] > lines[end[:-1]])
        begin = np.flatnonzero(fresh)
        place = np.arange(len(start)) - np.repeat(begin, np.diff(np.append(begin, len(start))))
        sentence = np.cumsum(fresh | (place % LONGEST == 0)) - 1
        names, name = np.unique(name, return_inverse=True)
        _, once = np.unique(sentence * len(names) + name, return_index=True)
        total = np.bincount(sentence[once], share[once])
        worst = np.full(len(out), -np.inf)
        np.maximum.at(worst, text[np.unique(sentence, return_index=True)[1]], total)
        return out + np.where(np.isfinite(worst), worst, 0.0)

    def _joined(self, data: np.ndarray, single: np.ndarray, share: np.ndarray, name: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Three or more single letters with one blank between them become one word."""
        follows = np.zeros(len(start), bool)
        follows[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1]) & (start[1:] - end[:-1] == 1)
        if not (follows[1:] & follows[:-1]).any():
            return share, name, text, start, end
        begin = np.flatnonzero(~follows & np.append(follows[1:], False))
        stop = np.flatnonzero(follows & ~np.append(follows[1:], False)) + 1
        runs = [(a, b) for a, b in zip(begin.tolist(), stop.tolist(), strict=True) if b - a >= 3]
        words = [letters("".join(data[x:y].tobytes().decode() for x, y in zip(start[a:b], end[a:b], strict=True))) for a, b in runs]
        values, hashes = self.shares(words)
        keep, share, name, end = np.ones(len(start), bool), share.copy(), name.copy(), end.copy()
        for (a, b), v, h in zip(runs, values, hashes, strict=True):
            share[a], name[a], end[a] = v, h, end[b - 1]
            keep[a + 1 : b] = False
        return share[keep], name[keep], text[keep], start[keep], end[keep]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.machine.probability(self.margins(data, offsets))


def scorer_of(shared: Broadcast) -> Scorer:
    """A worker's scorer for a broadcast (name, machine), kept over its tasks."""
    name, machine = shared.value
    return K.worker_cache(f"toxicity {name}", lambda: Scorer(machine))


def shared_machine(spark: SparkSession, machine: Machine) -> Broadcast:
    return spark.sparkContext.broadcast((uuid.uuid4().hex, machine))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of docs."""
    shared = shared_machine(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            for part, data, offsets in K.blocks(batch, "text"):
                yield pa.record_batch([part.column("key"), pa.array(scorer(data, offsets))], names=["key", "score"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs."""
    scored = score(docs, train(*sample(docs, labels, key, text)), key, text)
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; nothing is moved."""
    shared = shared_machine(docs.sparkSession, train(*sample(docs, labels, key, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            for part, data, offsets in K.blocks(batch, text):
                yield part.filter(pa.array(scorer(data, offsets) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

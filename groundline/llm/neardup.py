"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

A document's set holds its distinct word shingles as 64-bit hashes. Documents with equal sets are one node from the start,
so copies cost one row. A node's signature has one value a coordinate; each coordinate-value pair is a posting list. A pair
of nodes is a candidate if at least ``MATCHES`` of ``COORDINATES`` values agree: at a similarity of 0.8 a pair falls below
that with a probability under 1e-6. Prefix merging: with values in order of rising frequency, such a pair shares one of
its first COORDINATES - MATCHES + 1 values, so only these are posted; values that stand once use up places and are skipped.

Posting lists are never expanded into pairs of rows. Each list has a leader, its node of the most frequent values; a cell
is a leader with all nodes of its lists, so every pair that shares a posted value meets in a cell. First every node is
compared with its leaders, and links join nodes into components. In cells that then hold several components, nodes of
different components are compared with each other: a cell is dealt to tasks as pairs of bounded chunks, members of its
largest component are never compared among themselves, signatures are compared first, and only nodes with a candidate are
compared on their full sets, all of a chunk's at once. A task returns a spanning forest of the links it finds, so rows
grow with the nodes, not with the pairs. Chunk pairs of a cell still grow with its nodes outside the largest component
times its size. No link between candidates is lost; links within one component would not change the result.

Null, empty and blank texts have an empty set, link with nothing and are components of their own. Fewer words than a
shingle has are one shingle. Repeated rows are linked and get a row each; of equal keys with different texts each row is
judged by its text. A row with a null key is in a component like others, whose id is the least key that is not null;
``link_classes`` marks it as kept only if its text is empty. ``deduplicate`` goes by rows: it leaves one row of each class,
a row with a null key where there is no other. An empty table gives an empty result. Only key and text are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import kernels as K
from groundline.llm.graph import components
from groundline.llm.tables import cut, free_name, read, row_hash, shards_for

COORDINATES = 64
MATCHES = 34
#: Slots of the filter that tells which sets are needed: a fixed 2 MB, whatever the input. Other sets pass at times and cost only time.
SLOTS = 1 << 24
SHINGLE = 5
#: Nodes whose values are counted together, and nodes and shingles of a chunk of a cell.
BLOCK_NODES = 16_384
CHUNK, CHUNK_SHINGLES = 500, 1 << 21
#: A signature that is kept in memory by this many rows a task is not sent again.
SEEN = 1_000_000

_seeds = K.mix(np.arange(1, 2 * COORDINATES + 1, dtype=K.U) * K.U(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and where each text's begin."""
    data = K.LOWER[data]
    starts, ends, ptr = K.word_spans(data, offsets)
    h = K.span_hash(K.prefix_hash(data), starts, ends)
    n = len(h)
    grams = np.full(n, K.U(words), K.U)
    for k in range(words):
        grams[: n - k] = grams[: n - k] * K.U(0xD1342543DE82EF95) + h[k:]
    grams = K.mix(grams)
    sets, sizes = [], [0]
    for a, b in zip(ptr[:-1], ptr[1:], strict=True):
        if b - a >= words:
            s = np.unique(grams[a : b - words + 1])
        elif b > a:
            whole = np.full(1, b - a, K.U)
            for i in range(a, b):
                whole = whole * K.U(0xD1342543DE82EF95) + h[i : i + 1]
            s = K.mix(whole)
        else:
            s = np.zeros(0, K.U)
        sets.append(s)
        sizes.append(len(s))
    return np.concatenate(sets) if sets else np.zeros(0, K.U), np.cumsum(sizes)


def node_ids(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set's content."""
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(sets ^ K.U(0x5851F42D4C957F2D)), dtype=K.U)])
    return K.mix((total[ptr[1:]] - total[ptr[:-1]]) ^ (np.diff(ptr).astype(K.U) << K.U(40)))


def signatures(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) of 32 bits each: a hash of the least value of each coordinate's hash; 0 for an empty set."""
    out = np.zeros((len(ptr) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        for j in range(COORDINATES):
            x = (sets + _seeds[2 * j]) * (_seeds[2 * j + 1] | K.U(1))
            x ^= x >> K.U(32)
            x *= K.U(0x9FB21C651E98DF25)
            out[full, j] = K.mix(np.minimum.reduceat(x, ptr[full])) >> K.U(32)
    return out


def sign(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n_shingles, node, signature) of every row; node and signature are null for an empty set.

    A task sends a node's signature with the first row that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.forget()
        seen: set[int] = set()
        for batch in batches:
            for part, data, offsets in K.blocks(batch, "_text"):
                sets, ptr = shingle_sets(data, offsets, words)
                node, empty = node_ids(sets, ptr).view(np.int64), np.diff(ptr) == 0
                known = np.array([e or n in seen or seen.add(n) is not None for n, e in zip(node.tolist(), empty.tolist(), strict=True)], bool)
                if len(seen) > SEEN:
                    seen.clear()
                rows = pa.array([x.tobytes() for x in signatures(sets, ptr)], pa.binary())
                yield pa.record_batch([part.column("_key"), pa.array(np.diff(ptr)), pa.array(node, mask=empty), pa.compute.if_else(pa.array(known), pa.scalar(None, pa.binary()), rows)], names=["_key", "n_shingles", "node", "signature"])

    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("signature", T.BinaryType())])
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def wanted_sets(docs: DataFrame, nodes: DataFrame, text: str, words: int) -> DataFrame:
    """(node, shingles): the full sets of the given nodes, by a second pass over the texts.

    A bit table of SLOTS places lets the workers drop nearly all other sets before they are moved.
    """
    slot = F.col("node").bitwiseAND(SLOTS - 1)
    bits = nodes.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((node & {SLOTS - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(K.U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.forget()
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in K.blocks(batch, text):
                sets, ptr = shingle_sets(data, offsets, words)
                node = node_ids(sets, ptr)
                at = node & K.U(SLOTS - 1)
                keep = ((shared.value[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63))) & K.U(1)).astype(bool) & (np.diff(ptr) > 0)
                rows = [i for i in np.flatnonzero(keep) if int(node[i]) not in seen and not seen.add(int(node[i]))]
                yield pa.record_batch([pa.array(node[rows].view(np.int64)), pa.array([sets[ptr[i] : ptr[i + 1]].tobytes() for i in rows], pa.binary())], names=["node", "shingles"])

    found = docs.select(text).mapInArrow(run, "node long, shingles binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(x: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _sorted_tokens(signature: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of a block in order of (shard, token), how often each stands there, and each place's token."""
    token = signature.astype(K.U) | (np.arange(COORDINATES, dtype=K.U) << K.U(32))
    distinct, back, count = np.unique(token.ravel(), return_inverse=True, return_counts=True)
    shard = K.mix(distinct) % K.U(shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], count[order], place[back.reshape(signature.shape)]


def postings(signed: DataFrame, shards: int) -> DataFrame:
    """(token, node, fame): each node's prefix of rare coordinate values, those that stand once left out.

    Blocks of nodes send their distinct values, sorted and packed, to shards by hash; a shard adds up how often each
    value stands and answers every block with its values' totals. fame sums the totals of a node's values that stand
    more than once: it is greatest in the middle of a group.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def made(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal block
            block += 1
            node = part.column("node").to_numpy()
            signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token, count, _ = _sorted_tokens(signature, shards)
            shard = (K.mix(token) % K.U(shards)).astype(np.int64)
            ends = np.searchsorted(shard, np.arange(shards + 1))
            used = np.flatnonzero(np.diff(ends))
            cuts = [(int(ends[k]), int(ends[k + 1])) for k in used]
            yield pa.record_batch([pa.array(np.full(len(used) + 1, block)), pa.array([-1, *used.tolist()], pa.int64()), pa.array([len(node), *[b - a for a, b in cuts]], pa.int64()), pa.array([node.tobytes(), *[_pack(token[a:b]) for a, b in cuts]], pa.binary()), pa.array([signature.tobytes(), *[_pack(count[a:b].astype(np.uint32)) for a, b in cuts]], pa.binary())], names=["block", "shard", "n", "x", "y"])

        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= BLOCK_NODES:
                held.append(batch.slice(0, BLOCK_NODES - n))
                batch, n = batch.slice(BLOCK_NODES - n), 0
                yield from made(pa.Table.from_batches(held))
                held = []
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from made(pa.Table.from_batches(held))

    def totals(table: pa.Table) -> pa.Table:
        n, own = table.column("n").to_pylist(), table.column("x").to_pylist()
        token = np.concatenate([_unpack(x, K.U, k) for x, k in zip(own, n, strict=True)])
        count = np.concatenate([_unpack(x, np.uint32, k) for x, k in zip(table.column("y").to_pylist(), n, strict=True)])
        _, back = np.unique(token, return_inverse=True)
        total = np.bincount(back, count).astype(np.int64)[back]
        ends = np.cumsum(n)
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "n": table.column("n"), "x": pa.array([_pack(total[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary())})

    def posted(nodes: pa.Table, answers: pa.Table) -> pa.Table:
        node = np.frombuffer(nodes.column("x")[0].as_py(), np.int64)
        signature = np.frombuffer(nodes.column("y")[0].as_py(), np.uint32).reshape(-1, COORDINATES)
        token, _, place = _sorted_tokens(signature, shards)
        answers = answers.sort_by("shard")
        total = np.concatenate([_unpack(x, np.int64, k) for x, k in zip(answers.column("x").to_pylist(), answers.column("n").to_pylist(), strict=True)])
        n = total[place]
        often = n > 1
        places = np.maximum(often.sum(1) - (MATCHES - 1), 0)
        fame = np.where(often, n, 0).sum(1)
        # one order of values for all nodes: by total, then by value; those that stand once come first and are skipped
        rank = np.empty(len(token), np.int64)
        rank[np.lexsort((token, total))] = np.arange(len(token))
        order = np.argsort(rank[place], axis=1)
        at = np.arange(COORDINATES) - (COORDINATES - often.sum(1))[:, None]
        chosen = (at >= 0) & (at < places[:, None])
        row = np.nonzero(chosen)[0]
        return pa.table({"token": token[np.take_along_axis(place, order, 1)[chosen]].view(np.int64), "node": node[row], "fame": fame[row]})

    made = cut(signed.select("node", "signature").mapInArrow(blocks, "block long, shard long, n long, x binary, y binary"))
    answers = made.filter("shard >= 0").groupBy("shard").applyInArrow(totals, "block long, shard long, n long, x binary")
    return made.filter("shard < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(posted, "token long, node long, fame long")


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(-1)


def _low_bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _alike(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sizes and signatures allow the similarity. Signatures are compared by a byte a value."""
    side = lambda x: signed.select(F.col("node").alias(x), F.col("bytes").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(_matches(_low_bytes(batch.column("sa")), _low_bytes(batch.column("sb"))) >= MATCHES))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut(wanted_sets(docs, nodes, text, words))
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut(both.mapInArrow(run, "a long, b long"))


def _dealt(met: DataFrame, roots: DataFrame, signed: DataFrame) -> DataFrame:
    """(leader, i, j, node, root, n_shingles, bytes): the cells that hold several components, as pairs of chunks.

    A small cell is one group. Of a larger one the members of its largest component are dealt to chunks, and so are the
    other nodes; each chunk of the others meets every chunk.
    """
    placed = met.join(roots.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    info = placed.join(signed.select("node", "n_shingles", "bytes"), "node")
    by_root = info.groupBy("leader", "root").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("size"))
    cells = by_root.groupBy("leader").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "size", "root")).alias("main"), F.sum("k").alias("k"), F.sum("size").alias("size")).filter("kinds > 1")
    chunks = lambda k, size: F.greatest(F.ceil(k / CHUNK), F.ceil(size / CHUNK_SHINGLES), F.lit(1)).cast("int")
    cells = cells.select("leader", F.col("main.root").alias("main"), chunks(F.col("k"), F.col("size")).alias("all"), chunks(F.col("main.k"), F.col("main.size")).alias("inner"), chunks(F.col("k") - F.col("main.k"), F.col("size") - F.col("main.size")).alias("outer"))
    own = info.join(cells, "leader")
    inside, hashed = F.col("root") == F.col("main"), F.xxhash64("node")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    at_in, at_out = F.pmod(hashed, F.col("inner")).cast("int"), F.pmod(hashed, F.col("outer")).cast("int")
    inner, outer = F.sequence(F.lit(0), F.col("inner") - 1), F.sequence(F.lit(0), F.col("outer") - 1)
    # chunks of others are numbered from 0, chunks of the largest component from -1 downwards
    of_inside = F.transform(outer, lambda j: pair(j, -1 - at_in))
    of_outside = F.concat(F.transform(inner, lambda i: pair(at_out, -1 - i)), F.transform(outer, lambda j: pair(F.least(j, at_out), F.greatest(j, at_out))))
    groups = F.when(F.col("all") == 1, F.array(pair(F.lit(0), F.lit(0)))).when(inside, of_inside).otherwise(of_outside)
    return own.select("leader", "node", "root", "n_shingles", "bytes", F.explode(groups).alias("g")).select("leader", "g.i", "g.j", "node", "root", "n_shingles", "bytes")


def _candidates(root: np.ndarray, n: np.ndarray, values: np.ndarray, percent: int) -> np.ndarray:
    """(nodes, nodes): may the pair be a link that joins two components? By sizes and signatures, in strips."""
    out = np.zeros((len(n), len(n)), bool)
    for a in range(0, len(n), 64):
        b = min(a + 64, len(n))
        fits = (root[a:b, None] != root) & (100 * np.minimum(n[a:b, None], n) >= percent * np.maximum(n[a:b, None], n))
        i, j = np.nonzero(fits)
        out[a + i, j] = _matches(values[a + i], values[j]) >= MATCHES
    return out


def common_sizes(sets: list[np.ndarray], strip: int = 8192) -> np.ndarray:
    """(sets, sets): how many elements each two have in common, by products of membership matrices, a strip at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    element, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(element), -1, np.int64)
    number[shared] = np.arange(len(shared))
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), number[back]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, len(shared), strip):
        lo, hi = np.searchsorted(column, [a, a + strip])
        inside = np.zeros((len(sets), min(strip, len(shared) - a)), np.float32)
        inside[row[lo:hi], column[lo:hi] - a] = 1
        out += inside @ inside.T
    return out


def spanning_forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a spanning forest of a symmetric adjacency matrix."""
    left, child, parent = links.any(1), [], []
    while left.any():
        front = [int(np.argmax(left))]
        left[front[0]] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(links[at] & left)
            left[new] = False
            child += new.tolist()
            parent += [at] * len(new)
            front += new.tolist()
    return np.array(child, np.int64), np.array(parent, np.int64)


def _across(met: DataFrame, roots: DataFrame, signed: DataFrame, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(a, b): links that join different components of a cell, a spanning forest for each pair of chunks."""
    dealt = cut(_dealt(met, roots, signed))

    def near(table: pa.Table) -> pa.Table:
        root, n = table.column("root").to_numpy(), table.column("n_shingles").to_numpy()
        return table.filter(pa.array(_candidates(root, n, _low_bytes(table.column("bytes")), percent).any(1)))

    groups = ["leader", "i", "j"]
    wanted = cut(dealt.groupBy(*groups).applyInArrow(near, dealt.schema))
    sets = wanted_sets(docs, wanted.select("node").distinct(), text, words)
    full = wanted.join(sets, "node")

    def linked(table: pa.Table) -> pa.Table:
        root, n, node = (table.column(c).to_numpy() for c in ("root", "n_shingles", "node"))
        able = _candidates(root, n, _low_bytes(table.column("bytes")), percent)
        common = common_sizes([np.frombuffer(x.as_buffer(), K.U) for x in table.column("shingles")])
        K.give_back()
        a, b = spanning_forest(able & (100 * common >= percent * (n[:, None] + n - common)))
        return pa.table({"a": node[a], "b": node[b]})

    return full.groupBy(*groups).applyInArrow(linked, "a long, b long").distinct()


def _placed(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(_key, n_shingles, node, class) of every row of docs; class is null for an empty set."""
    rows = cut(sign(docs, key, text, words))
    signed = rows.filter("signature is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    shards = shards_for(docs.sparkSession, rows.count() * COORDINATES * 9)
    signed = cut(_with_bytes(signed))
    posted = cut(postings(signed, shards))
    leaders = posted.groupBy("token").agg(F.max(F.struct("fame", "node")).alias("l"), F.count("*").alias("k")).filter("k > 1").select("token", F.col("l.node").alias("leader"))
    met = cut(posted.select("token", "node").join(leaders, "token").select("leader", "node").distinct())
    star = met.filter("leader <> node").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    first = _confirmed(_alike(star, signed, percent), docs, text, words, percent)
    roots = cut(components(first))
    more = cut(_across(met, roots, signed, docs, text, words, percent))
    roots = cut(components(first.union(more)))
    return rows.select("_key", "n_shingles", "node").join(roots, "node", "left").withColumn("class", F.coalesce("component", "node"))


def _with_bytes(signed: DataFrame) -> DataFrame:
    """signed with the lowest byte of each value of the signature; two different values agree in it by chance once in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint8)
            yield batch.append_column("bytes", pa.array([x.tobytes() for x in low], pa.binary()))

    return signed.mapInArrow(run, T.StructType([*signed.schema.fields, T.StructField("bytes", T.BinaryType())]))


def link_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs."""
    placed = _placed(docs, key, text, words, percent)
    least = placed.filter("node is not null").groupBy("class").agg(F.min("_key").alias("least"))
    out = placed.join(least, "class", "left")
    component = F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("least"))
    return out.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_key") == component, F.col("node").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with all their columns: one row of each class, that of its least key, nulls last.

    Rows go by key and text. Rows with an empty set are all kept, but for repetitions of key and text.
    """
    named = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), row_hash(key, text).alias("row")).alias("who"), F.col(text).alias("text"))
    placed = _placed(named, "who", "text", words, percent)
    first = placed.filter("class is not null").groupBy("class").agg(F.min("_key").alias("_key")).select("_key")
    chosen = cut(first.union(placed.filter("class is null").select("_key").distinct()).select(F.col("_key.row").alias("row")))
    name = free_name(docs, "kept_row")
    row = row_hash(docs[key], docs[text])
    out = docs.join(chosen.withColumnRenamed("row", name), row == F.col(name), "left_semi")
    repeated = not placed.groupBy("_key").count().filter("count > 1").isEmpty()
    return out.dropDuplicates([key, text]) if repeated else out


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(read(spark, sf_dir, "documents"), words=2, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

"""Best-fit packing by hierarchical rounds.

Each partition packs its pieces best-fit, longest first, and emits the bins that are nearly full. The other bins become
items of the next round, in fewer and bounded groups, until one group is left or a round no longer merges anything. A bin
carries its members, of which it has at most ``capacity`` (each has a token at least), so no row and no group grows with
the input.

Texts that are null are empty; an empty text is the closing id alone, one piece of one token. Very long texts are cut into
pieces of ``capacity``. Repeated rows and equal lengths are packed as separate items; an empty table gives an empty result.
Columns beside key and text are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import bpe
from groundline.llm import kernels as K
from groundline.llm.tables import cut, read

CAPACITY = 2048
#: A bin with so few free places, as a share of the capacity, is emitted at once.
SLACK = 1 / 256
#: Items that one task packs at a time.
GROUP = 100_000
#: Places for the round and group in a sequence's number.
ROUND, PART = 1 << 56, 1 << 30


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text: its ids and then id 0, cut only where longer."""
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([docs.schema[key], *[T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_block = bpe.encoder(path)
        for batch in batches:
            for part, data, offsets in K.blocks(batch, text, bpe.TEXT_BLOCK):
                ids, starts = encode_block(data, offsets)
                body = memoryview(np.insert(ids, starts[1:], 0).astype("<i4").tobytes())
                sizes = np.diff(starts) + 1
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[row] + start
                parts = [body[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                kept = [pa.array([bytes(x) for x in parts], pa.binary())] if keep_ids else []
                yield pa.record_batch([part.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), crc, *kept], names=names)

    return docs.select(key, text).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each bin: longest first, each into the fullest bin that still takes it.

    Bins stand in one stack per number of free places; a bit mask of the stacks in use finds the best fit at once.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in order:
        size = sizes[i]
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                used &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            free[room].append(at)
            used |= 1 << room
    return bins


def pack(items: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, group: int = GROUP) -> DataFrame:
    """All columns of items and (sequence_id, offset): items of one sequence_id fill it gapless from 0.

    ``items`` needs a column length, of 1 to capacity; columns of its own with the names of the two are replaced.
    """
    items = items.drop(*[c for c in items.columns if c.lower() in ("sequence_id", "offset")])
    full = capacity - int(capacity * slack)
    member = T.StructType(items.schema.fields)
    bin_type = T.StructType([T.StructField("total", T.LongType()), T.StructField("members", T.ArrayType(member)), T.StructField("sequence_id", T.LongType())])
    if items.isEmpty():
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})

    def packed(level: int, last: bool, size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, made = TaskContext.get().partitionId(), 0

            def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                nonlocal made
                rows = rows.combine_chunks()
                total, members = rows.column("total").combine_chunks(), rows.column("members").combine_chunks()
                bins = best_fit(total.to_pylist(), capacity)
                sizes = total.to_numpy(zero_copy_only=False)
                flat = pa.array([i for b in bins for i in b], pa.int64())
                taken = members.take(flat)
                ends, at, offsets = taken.offsets.to_numpy(), 0, [0]
                for b in bins:
                    at += len(b)
                    offsets.append(int(ends[at] - ends[0]))
                totals = [int(sizes[b].sum()) for b in bins]
                ids = [level * ROUND + part * PART + made + k if last or t >= full else None for k, t in enumerate(totals)]
                made += len(bins)
                for k in range(0, len(bins), 2000):
                    cut_offsets = pa.array(offsets[k : k + 2001], pa.int32())
                    lists = pa.ListArray.from_arrays(cut_offsets, taken.flatten())
                    yield pa.record_batch([pa.array(totals[k : k + 2000], pa.int64()), lists, pa.array(ids[k : k + 2000], pa.int64())], names=["total", "members", "sequence_id"])

            held, n = [], 0
            for batch in batches:
                while n + batch.num_rows >= size:
                    held.append(batch.slice(0, size - n))
                    batch = batch.slice(size - n)
                    yield from emit(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
            if n:
                yield from emit(pa.Table.from_batches(held))

        return run

    loose = items.select(F.col("length").cast("long").alias("total"), F.array(F.struct(*items.columns)).alias("members"))
    done: list[DataFrame] = []
    level, before = 0, None
    while True:
        bins = cut(loose.mapInArrow(packed(level, False, group), bin_type))
        done.append(bins.filter("sequence_id is not null"))
        loose = bins.filter("sequence_id is null").select("total", "members")
        n = loose.count()
        if before is not None and (before[1] == 1 or n == before[0]):
            # one group has met, or no bin found another: what is left is emitted as it is
            rest = bins.filter("sequence_id is null").withColumn("sequence_id", F.lit((level + 1) * ROUND) + F.monotonically_increasing_id())
            done.append(cut(rest) if n else rest)
            break
        parts = max(1, -(-n // group))
        loose = loose.repartition(parts)
        before, level = (n, parts), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # offsets: each bin's members in their order; a running sum over at most `capacity` lengths, built in one pass
    ran = F.aggregate("members", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")), lambda a, m: F.struct((a.at + m.length).alias("at"), F.concat(a.starts, F.array(a.at)).alias("starts"))).starts
    zipped = out.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), ran.alias("o"))).alias("z"))
    return zipped.select(*[F.col(f"z.m.{c}").alias(c) for c in items.columns], "sequence_id", F.col("z.o").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the little-endian 32-bit ids of each sequence, from pieces packed with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p.ids)).alias("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut(pieces(read(spark, sf_dir, "documents"), bpe.tokenizer_path()))
    return pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

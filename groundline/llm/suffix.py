"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another one.

Every window of LENGTH bytes has an anchor: the least hash of its GRAM-byte pieces. Equal windows have equal anchors, so
a region - a run of windows of one text with one anchor - needs to be compared only with regions of the same anchor. Equal
regions are one region with a count from the start, so copies cost one row each and are never gathered; only anchors with
several different regions need sorting. Their regions are dealt to shards by anchor, of bounded size each. A shard's
suffixes are ranked by Larsson-Sadakane refinement (prefix doubling, only groups that are not yet single), common prefixes
follow by Kasai's bound, and a window whose neighbour in the suffix array shares LENGTH bytes is repeated. An anchor with
more bytes than a shard takes is dealt to several; the sorted lists of their distinct windows, by two hashes of 64 bits,
are then merged by binary search. A region's repeated windows are one row, however many runs they form.

Null texts are empty; texts below LENGTH bytes are kept whole. Very long texts are read in bounded regions. Repeated rows
repeat each other, so texts of LENGTH bytes or more go from all of them. Rows with equal keys and different texts are told
apart by their texts. An empty table gives an empty result. Columns beside key and text may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import kernels as K
from groundline.llm.tables import cut, free_name, read

LENGTH = 400
GRAM = 64
#: A passage of so many whole words goes although it has less than LENGTH bytes. It is found by windows of PASSAGE bytes:
#: so many words of three letters and their blanks have 203 bytes.
WORDS = 51
PASSAGE = 200
#: Windows of a region at most; longer runs are several regions.
RUN = 2048
#: Bytes of regions that a shard holds, as a rule; an anchor with more is dealt to several.
SHARD_BYTES = 1 << 20
#: Windows that a merge across shards holds, as a rule.
MERGED = 1 << 20
#: Slots of the filter that tells which regions are needed: a fixed 2 MB, whatever the input.
SLOTS = 1 << 24


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: two running minima over blocks of that width."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    padded = np.full(-(-len(h) // width) * width, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor, content, inner) of each region of a block; start is counted from the text's first byte.

    inner: the anchor stands several times in the region, so windows may repeat inside it.
    """
    gram = min(GRAM, max(1, length // 6))
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(K.U), empty.view(K.U), empty.astype(bool)
    prefix = K.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = K.span_hash(prefix, at, at + gram)
    least = sliding_min(hashes, length - gram + 1)
    step = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    step[offsets[long]] += 1
    step[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(step[: len(least)], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    edges = np.flatnonzero(valid & ~np.concatenate([valid[1:], [False]])) + 1
    nexts = np.concatenate([start[1:], [len(least)]])
    end = np.minimum(nexts, edges[np.searchsorted(edges, start, "right")]) if len(start) else start
    if len(start) and (end - start).max() > RUN:
        parts = -(-(end - start) // RUN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        k = np.arange(parts.sum()) - first
        start, end = np.repeat(start, parts) + k * RUN, np.repeat(end, parts)
        end = np.minimum(end, start + RUN)
    row = np.searchsorted(offsets, start, "right") - 1
    inner = _inner(hashes, start, end, least[start], length - gram + 1)
    return row, start - offsets[row], end - start, least[start], K.span_hash(prefix, start, end + length - 1), inner


def _inner(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """For each region: does its anchor stand at two places that a window of it spans, or meet at a step?"""
    out = np.zeros(len(start), bool)
    if not len(start):
        return out
    table = np.zeros(1 << 18, bool)  # a coarse test spares most of the search
    table[(anchor & K.U((1 << 18) - 1)).astype(np.int64)] = True
    place = np.flatnonzero(table[(hashes & K.U((1 << 18) - 1)).astype(np.int64)])
    names = np.unique(anchor)
    number = np.minimum(np.searchsorted(names, hashes[place]), len(names) - 1)
    known = names[number] == hashes[place]
    place, number = place[known], number[known]
    by = np.argsort(number * (len(hashes) + 1) + place)
    place, number = place[by], number[by]
    near = np.flatnonzero((number[1:] == number[:-1]) & (place[1:] - place[:-1] <= width))
    if len(near):
        key = np.searchsorted(names, anchor) * (len(hashes) + 1) + start
        order = np.argsort(key)
        at = np.searchsorted(key[order], number[near] * (len(hashes) + 1) + place[near], "right") - 1
        near, at = near[at >= 0], order[at[at >= 0]]
        fits = (anchor[at] == names[number[near]]) & (end[at] - 1 >= place[near + 1] - width)
        out[at[fits]] = True
    return out


def suffix_array(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes; a suffix ends at its region's limit, equal ones stand in order of position.

    Larsson-Sadakane refinement: ranks by 7 bytes, then doubled; only positions in groups of several that reach beyond
    the bytes compared so far are sorted again.
    """
    n = len(data)
    left = limits - np.arange(n)
    h = 7
    key = np.zeros(n, K.U)
    for k in range(h):
        key[: n - k] |= np.where(left[: n - k] > k, data[k:].astype(K.U) << K.U(56 - 8 * k), K.U(0))
    key |= np.minimum(left, h).astype(K.U)  # a suffix that ends here sorts before one that goes on with zero bytes
    order = np.argsort(key)
    change = np.ones(n, bool)
    change[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes) + 1
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(active):
        at = order[active]
        going = left[at] >= h  # groups of suffixes that have ended are done, each as a whole
        if not going.all():
            ended, at = at[~going], at[going]
            order[active[~going]] = ended[np.argsort((rank[ended].astype(K.U) << K.U(32)) | ended.astype(K.U))]
            active = active[going]
            if not len(active):
                break
        ahead = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)], 0)
        key = (rank[at].astype(K.U) << K.U(32)) | ahead.astype(K.U)
        by = np.argsort(key)
        key, at = key[by], at[by]
        change = np.ones(len(at), bool)
        change[1:] = key[1:] != key[:-1]
        order[active] = at
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(active[starts] + 1, sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, limits: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, ``depth`` at most, each suffix shares with the one before it in order; by position in the data.

    Kasai's bound, a stride at a time: a suffix that starts d bytes later shares at least d bytes less. Positions at the
    widest stride are compared first, then those between them, each from its bound on.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    left = np.minimum(limits - np.arange(n), depth)
    stride, first = 64, True
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    while stride >= 1:
        at = np.arange(0, n, stride) if first else np.arange(stride, n, 2 * stride)
        other = before[at]
        at, other = at[other >= 0], other[other >= 0]
        bound = np.minimum(left[at], left[other])
        have = np.zeros(len(at), np.int64) if first else np.maximum(shared[at - stride] - stride, 0)
        have = np.minimum(have, bound)
        going = np.arange(len(at))
        while len(going):
            i, j, l = at[going], other[going], have[going]
            same = words[np.minimum(i + l, n)] == words[np.minimum(j + l, n)]
            k = np.where(same.all(1), 8, same.argmin(1))
            have[going] = np.minimum(l + k, bound[going])
            going = going[(k == 8) & (have[going] < bound[going])]
        shared[at] = have
        stride, first = stride // 2, False
    return shared


def repeated_windows(texts: list[bytes], windows: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all regions, one after the other: is it repeated; then its region, its place there, and the
    distinct windows (as indices of their first window) in suffix order."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    limits = np.repeat(ends, sizes)
    order = suffix_array(data, limits)
    shared = common_prefixes(data, limits, order, length)
    region = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(region)) - np.repeat(np.cumsum(windows) - windows, windows)
    position = (ends - sizes)[region] + place
    is_window = np.zeros(len(data), bool)
    is_window[position] = True
    same = (shared >= length)[order]
    hit = np.zeros(len(data), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    return hit[position] | (counts[region] > 1), region, place, position, order[~same]


def _spans(flags: np.ndarray, region: np.ndarray, regions_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows: (region, first window's index, index after the last one)."""
    on = flags.astype(np.int8)
    edge = np.append(True, region[1:] != region[:-1]) if len(region) else np.zeros(0, bool)
    start = np.flatnonzero((on == 1) & (np.append(0, on[:-1]) == 0) | (on == 1) & edge)
    ends = np.flatnonzero((on == 1) & (np.append(on[1:], 0) == 0) | (on == 1) & np.append(edge[1:], True)) + 1 if len(on) else start
    return region[start], start, ends


def _scan(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(row_key, start, windows, anchor, content, inner) of the regions of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.forget()
        for batch in batches:
            for part, data, offsets in K.blocks(batch, "_text"):
                row, start, windows, anchor, content, inner = regions(data, offsets, length)
                yield pa.record_batch([part.column("row_key").take(pa.array(row)), pa.array(start), pa.array(windows), K.as_long(anchor), K.as_long(content), pa.array(inner)], names=["row_key", "start", "windows", "anchor", "content", "inner"])

    return _keyed(docs, key, text).mapInArrow(run, "row_key long, start long, windows long, anchor long, content long, inner boolean")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row_key"), F.col(text).alias("_text"))


def _wanted(docs: DataFrame, wanted: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(anchor, content, body) of the wanted regions, by a second pass; each task sends a region once."""
    slot = F.expr(f"anchor & {SLOTS - 1}")
    bits = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((anchor & {SLOTS - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(K.U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, data, offsets in K.blocks(batch, "_text"):
                row, start, windows, anchor, content, _ = regions(data, offsets, length)
                at = anchor & K.U(SLOTS - 1)
                keep = np.flatnonzero((shared.value[(at >> K.U(6)).astype(np.int64)] >> (at & K.U(63))) & K.U(1))
                keep = np.array([i for i in keep if int(content[i]) not in sent and not sent.add(int(content[i]))], np.int64)
                if len(sent) > 2_000_000:
                    sent.clear()
                begin = offsets[row[keep]] + start[keep]
                bodies = [data[b : b + w + length - 1].tobytes() for b, w in zip(begin, windows[keep], strict=True)]
                yield pa.record_batch([K.as_long(anchor[keep]), K.as_long(content[keep]), pa.array(bodies, pa.binary())], names=["anchor", "content", "body"])

    return _keyed(docs, key, text).mapInArrow(run, "anchor long, content long, body binary")


SPANS = "array<struct<a:bigint,b:bigint>>"


def _listed(region: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The regions that have runs, each with its runs as one list; runs are given in order of their regions."""
    first = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(region) else np.zeros(0, np.int64)
    runs = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return region[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(region)), pa.int32()), runs)


def _sorted_spans(bodies: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(anchor, content, spans): the runs [a, b) of a region's repeated windows, found in shards' suffix arrays.

    bodies has anchor, content, windows, n (the region's count), bytes and places (of all regions and windows of its
    anchor) and body. An anchor of more than shard_bytes is dealt to several shards; each sends the hashes of its sorted
    distinct windows, packed, to merges of bounded size, a range of hashes each.
    """
    total = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, int(total // shard_bytes) + 1)
    salts = F.ceil(F.col("bytes") / shard_bytes).cast("int")
    salt = F.pmod(F.xxhash64("content"), salts).cast("int")
    dealt = bodies.withColumn("salt", salt).withColumn("shard", F.when(salts > 1, F.xxhash64("anchor", "salt")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    dealt = dealt.withColumn("parts", F.when(salts > 1, F.ceil(F.col("places") / MERGED)).otherwise(F.lit(0)).cast("long"))
    schema = f"anchor long, content long, spans {SPANS}, shard long, part long, listed binary"
    arrow = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("shard", pa.int64()), ("part", pa.int64()), ("listed", pa.binary())])
    packed = np.dtype([("window", K.U), ("check", K.U), ("content", np.int64), ("place", np.int64)])

    def rows(**columns) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in arrow}).cast(arrow)

    def ranked(table: pa.Table) -> pa.Table:
        K.give_back()  # of the shard before
        table = table.combine_chunks()
        texts = table.column("body").to_pylist()
        windows, counts, parts = (table.column(c).to_numpy() for c in ("windows", "n", "parts"))
        flags, region, place, position, distinct = repeated_windows(texts, windows, counts, length)
        at, start, end = _spans(flags, region, len(texts))
        base = (np.cumsum(windows) - windows)[at]
        anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
        one, spans = _listed(at, start - base, end - base)
        out = [rows(anchor=pa.array(anchor[one]), content=pa.array(content[one]), spans=spans)]
        if parts.any():
            # distinct windows of an anchor that other shards hold, too
            data = np.frombuffer(b"".join(texts), np.uint8)
            number = np.full(len(data), -1, np.int64)
            number[position] = np.arange(len(position))
            w = number[distinct]
            w = w[w >= 0]
            w = w[parts[region[w]] > 0]
            r = region[w]
            listed = np.empty(len(w), packed)
            for name, letters in (("window", K.TABLE), ("check", K.OTHER_TABLE)):
                listed[name] = K.span_hash(K.prefix_hash(data, letters), position[w], position[w] + length)
            listed["content"], listed["place"] = content[r], place[w]
            part = (listed["window"] % parts[r].astype(K.U)).astype(np.int64)
            order = np.lexsort((listed["window"], part, anchor[r]))
            listed, part, of = listed[order], part[order], anchor[r][order]
            first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (of[1:] != of[:-1]))) if len(w) else np.zeros(0, np.int64)
            cuts = np.append(first, len(w)).tolist()
            lists = pa.array([listed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            out.append(rows(anchor=pa.array(of[first]), shard=pa.array(np.full(len(first), table.column("shard")[0].as_py())), part=pa.array(part[first]), listed=lists))
        return pa.concat_tables(out)

    found = cut(dealt.select("shard", "anchor", "content", "windows", "n", "parts", "body").groupBy("shard").applyInArrow(ranked, schema))

    def merged(table: pa.Table) -> pa.Table:
        """Windows that stand in several sorted lists: each list is searched for the others' windows."""
        lists = [np.frombuffer(x, packed) for x in table.column("listed").to_pylist()]
        hits = [np.zeros(len(x), bool) for x in lists]
        for i, x in enumerate(lists):
            for j, y in enumerate(lists):
                if i != j and len(y):
                    lo, hi = (np.searchsorted(y["window"], x["window"], side) for side in ("left", "right"))
                    # lists hold distinct windows: equal hashes are one window, unless the second hash tells them apart
                    hits[i] |= (lo < hi) & (y["check"][np.minimum(lo, len(y) - 1)] == x["check"])
                    for k in np.flatnonzero(hi - lo > 1):
                        hits[i][k] = hits[i][k] or (y["check"][lo[k] : hi[k]] == x["check"][k]).any()
        hit = np.concatenate([x[h] for x, h in zip(lists, hits, strict=True)])
        hit = hit[np.lexsort((hit["place"], hit["content"]))]
        new = np.ones(len(hit), bool)
        new[1:] = (hit["content"][1:] != hit["content"][:-1]) | (hit["place"][1:] != hit["place"][:-1] + 1)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(hit)) - 1 if len(hit) else start
        one, spans = _listed(hit["content"][start], hit["place"][start], hit["place"][last] + 1)
        return rows(anchor=pa.array(np.full(len(one), table.column("anchor")[0].as_py())), content=pa.array(one), spans=spans).select(["anchor", "content", "spans"])

    across = found.filter("listed is not null").groupBy("anchor", "part").applyInArrow(merged, f"anchor long, content long, spans {SPANS}")
    return found.filter("listed is null").select("anchor", "content", "spans").unionByName(across)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row_key, spans): for each text with repeats the windows' runs, as an array of (a, b) of first bytes."""
    found = cut(_scan(docs, key, text, length))
    kinds = found.groupBy("anchor", "content", "windows").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
    sizes = [F.sum(F.col("windows") + length - 1).alias("bytes"), F.sum("windows").alias("places")]
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("inner").alias("any_inner"), *sizes).filter("total > 1 or any_inner")
    kinds = cut(kinds.join(anchors, "anchor").select("anchor", "content", "windows", "n", "kinds", "least", "any_inner", "bytes", "places"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("windows").alias("b")))
    copied = kinds.filter("n > 1").select("anchor", "content", whole.alias("spans"))
    mixed = kinds.filter("(kinds > 1 or any_inner) and least = 1")
    if not mixed.isEmpty():
        bodies = _wanted(docs, mixed.select("anchor").distinct(), key, text, length)
        bodies = bodies.join(mixed, ["anchor", "content"]).groupBy("anchor", "content", "windows", "n", "bytes", "places").agg(F.first("body").alias("body"))
        copied = copied.unionByName(_sorted_spans(cut(bodies), length, shard_bytes))
    copied = copied.groupBy("anchor", "content").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    placed = found.select("row_key", "start", "anchor", "content").join(copied, ["anchor", "content"]).dropDuplicates(["row_key", "start", "anchor", "content"])
    moved = F.transform("spans", lambda s: F.struct((s.a + F.col("start")).alias("a"), (s.b + F.col("start")).alias("b")))
    return placed.groupBy("row_key").agg(F.array_sort(F.flatten(F.collect_list(moved))).alias("spans"))


def whole_words(data: bytes, a: int, b: int) -> int:
    """The words that stand wholly in data[a:b]; those that begin before it or end after it don't count."""
    run = data[a:b]
    cut_first = a > 0 and bool(run[:1].strip()) and bool(data[a - 1 : a].strip())
    cut_last = bool(run[-1:].strip()) and bool(data[b : b + 1].strip())
    return max(0, len(run.split()) - cut_first - cut_last)


def _kept(data: bytes, spans: list | None, length: int, passages: bool = False) -> tuple[list[bytes], int, int]:
    """What remains of a text, the bytes removed and the maximal removed runs; spans are sorted runs of windows.

    ``passages``: of the runs only those of LENGTH bytes or WORDS whole words go.
    """
    runs: list[list[int]] = []
    for s in spans or []:
        a, b = s["a"], s["b"] + length - 1
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    if passages:
        runs = [r for r in runs if r[1] - r[0] >= LENGTH or whole_words(data, *r) >= WORDS]
    cuts = [0, *(x for r in runs for x in r), len(data)]
    return [data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)], sum(b - a for a, b in runs), len(runs)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False, shard_bytes: int = SHARD_BYTES, passages: bool = False) -> DataFrame:
    """All rows and columns of docs with the repeated bytes gone from the text; bytes of a cut code point go, too.

    ``passages``: ``length`` is that of the windows, and of the runs that they cover those of LENGTH bytes or of WORDS whole
    words go, so that passages of many words go although they have less than LENGTH bytes.

    ``digest``: instead (key, n_bytes, n_removed, n_spans, kept_sha256), the hash being of the bytes as they remain.
    """
    row_key, of, at = (free_name(docs, c) for c in ("row_key", "of_row", "spans"))
    spans = cut(repeated_spans(docs, key, text, length, shard_bytes)).withColumnsRenamed({"row_key": row_key, "spans": at})
    columns = [key, text] if digest else list(docs.columns)
    both = docs.select(*columns, F.xxhash64(F.col(key), F.col(text)).alias(of))
    both = both.join(spans, F.col(of) == F.col(row_key), "left").select(*columns, at)
    numbers = ["n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in numbers], T.StructField("kept_sha256", T.StringType())]) if digest else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed, runs, digests = [], [], [], [], []
            for x, s in zip(batch.column(text), batch.column(at), strict=True):
                if not digest and not s.is_valid:
                    texts.append(x.as_py())
                    continue
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                left, gone, n = _kept(data, s.as_py(), length, passages)
                if digest:
                    sizes.append(len(data))
                    removed.append(gone)
                    runs.append(n)
                    digests.append(hashlib.sha256(b"".join(left)).hexdigest())
                else:
                    texts.append("".join(p.decode("utf-8", "ignore") for p in left))
            if digest:
                yield pa.record_batch([batch.column(key), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=[key, *numbers, "kept_sha256"])
            else:
                place = batch.schema.get_field_index(text)
                yield batch.set_column(place, text, pa.array(texts, pa.string())).select(columns)

    return both.mapInArrow(run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True)

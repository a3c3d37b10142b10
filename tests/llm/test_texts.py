"""Operators on texts against brute force, with the odd rows: nulls, empty and long texts, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundline.llm import bpe, fingerprint, graph, kernels, license, neardup, packing, quality, suffix, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if k % 6 == 1:  # a near copy of the row before
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "other"
        rows.append((k, " ".join(words).replace(" abc ", "\n"), "en" if k % 3 else None, "s", 0))
    rows += [(100, None, "en", None, None), (101, "", "en", "s", 0), (102, " \n\t", "en", "s", 0), (103, rows[3][1], "en", "s", 0), (103, rows[3][1], "en", "s", 0), (None, "one", None, None, None)]
    rows += [(104, "x y " * 4000, "en", "s", 0), (105, "Wort", "de", "s", 0), (106, "wort", "de", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names operators use themselves
    return spark.createDataFrame(documents(), SCHEMA).withColumns({c: F.lit(1) for c in ("node", "kept", "length", "_text", "row_key", "score", "word")}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- tokens
def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    mine, library = bpe.load(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(1)
    texts = ["", "Hello  World's 12 abc!! é  ", "a<|endoftext|>b <|startoftext|>X", "\x00 ​ İI ﬁ ①", "안녕 \U0001f600�", "a" * 3000, "#" * 2000, "ΑΣ Σ"]
    texts += ["".join(rng.choice("abc ' s.,é12\x1c\x85<|endoftext|>Σß\n̈A") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0xD000), rng.randrange(0x10000, 0x20000)])) for _ in range(20)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids, t
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_columns(spark, docs, none):
    path = bpe.tokenizer_path()
    got = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    mine = bpe.load(path)
    assert len(got) == docs.count() and all(r["decoded"] == mine.decode(mine.encode(r["text"])) for r in got)
    for r in bpe.round_trip_digests(docs, path).collect():
        if r["doc_id"] in (100, 101):
            assert (r["n_tokens"], r["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.round_trip_digests(none, path).count() == 0
    assert bpe.encode(docs.withColumn("ids", F.lit(1)), path).select("ids").dtypes == [("ids", "array<int>")]  # replaced
    clash = packing.pieces(docs, path, capacity=64).withColumns({"sequence_id": F.lit(1), "offset": F.lit("x")})
    assert packing.pack(clash, capacity=64).count() == clash.count()


def test_packing(spark, docs, none):
    path = bpe.tokenizer_path()
    made = packing.pieces(docs, path, capacity=64, keep_ids=True).cache()
    packed = packing.pack(made, capacity=64, group=40).cache()
    rows = packed.collect()
    assert len(rows) == made.count()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * -(-sum(r["length"] for r in rows) // 64) + 2
    assert {len(r["ids"]) // 4 for r in packing.sequences(packed).collect()} <= set(range(1, 65))
    assert packing.pack(packing.pieces(none, path)).count() == 0
    assert packing.best_fit([5, 4, 3, 2, 2], 8) == [[0, 2], [1, 3, 4]]


# ---- quality
def test_base_counts_by_brute_force():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", "ab ", "a b c d e f g h "]) for _ in range(rng.randint(0, 80))) for _ in range(80)] + ["", "w " * 50]
    data = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = quality.base_counts(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        seen, dup, windows, covered = set(), 0, collections.defaultdict(list), set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        for at in windows.values():
            if len(at) > 1:
                covered.update(x for k in at for x in range(k, k + 8))
        assert [int(got[c][i]) for c in quality.BASE] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    symbols, order = 6, 3
    grams, counts = np.unique(rng.integers(1, symbols, 400) * symbols**2 + rng.integers(1, 4, 400) * symbols + rng.integers(1, symbols, 400), return_counts=True)
    model = quality.KneserNey(grams, counts, symbols, order)
    for context in list({int(g) // symbols for g in grams}) + [0]:
        p = model.lookup(order, context * symbols + np.arange(symbols))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_quality_rejects_what_its_language_does_not_write(spark, none):
    rng = random.Random(3)
    words = ["the", "and", "there", "hand", "tree", "reed", "here", "then"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)), "en", "s", 0) for k in range(80)]
    rows += [(900, " ".join("zq#x$kj" for _ in range(15)) + " " + " ".join(f"q{k}z%" for k in range(40)), "en", "s", 0), (901, None, None, None, None), (902, "too short", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert not got[900]["kept"] and not got[901]["kept"] and not got[902]["kept"] and got[901]["base_failed"]
    assert sum(got[k]["kept"] for k in range(80)) == 80
    kept = quality.quality_filter(df.withColumn("kept", F.lit(1)))
    assert kept.columns == [*df.columns, "kept"] and kept.count() == 80
    assert quality.judge(none).count() == 0


# ---- toxicity
def test_subsequence_kernel():
    import itertools

    def brute(a, b):
        return sum(
            toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
            for i in itertools.combinations(range(len(a)), 3) for j in itertools.combinations(range(len(b)), 3) if all(a[x] == b[y] for x, y in zip(i, j, strict=True))
        )

    for a, b in [("idiot", "idxiot"), ("banana", "anna"), ("aaa", "aaaa"), ("ab", "abc")]:
        assert abs(brute(a, b) - toxicity.subsequence_kernel([a], [b])[0, 0]) < 1e-4 * (1 + brute(a, b))
        assert abs(brute(a, a) - toxicity.self_kernels([a])[0]) < 1e-6 * (1 + brute(a, a))


def test_toxicity(spark, none):
    rng = random.Random(4)
    clean = ["".join(rng.choice("thernadio") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows, labels = [], []
    for k in range(260):
        words = [rng.choice(clean) for _ in range(30)]
        if k % 4 == 0:
            words[7] = rng.choice(["blockhead", "numskull", "dimwit"])
        rows.append((k, " ".join(words) + ".", "en", "s", 0))
        labels.append((k, int(k % 4 == 0)))
    odd = {1000: "you num-skull", 1001: "b l o c k h e a d", 1002: "a bloxckhead", 1003: None, 1004: "", 1005: " ".join(clean[:20])}
    df = spark.createDataFrame(rows + [(k, t, None, None, None) for k, t in odd.items()], SCHEMA)
    lab = spark.createDataFrame(labels + [(7777, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(df, lab).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (k in held) for k, _ in labels)
    assert np.mean([got[k]["predicted"] == (k % 4 == 0) for k in held]) > 0.97
    assert all(got[k]["predicted"] == 1 for k in (1000, 1001, 1002)) and all(got[k]["predicted"] == 0 for k in (1003, 1004, 1005))
    assert got[1003]["score"] == got[1004]["score"]
    assert toxicity.judge(none, lab).count() == 0
    assert max(r["score"] for r in toxicity.judge(df, lab.filter("false")).collect()) < 1e-6


# ---- near-duplicates
def components_of(rows, words, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    out = []
    for members in groups.values():
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        for a in members:
            least = rows[a][0] if not sets[a] else min(ids, default=None)
            out.append((rows[a][0], len(sets[a]), least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_neardup_by_brute_force(spark, docs, words):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.link_classes(docs, words=words).collect()), key=repr)
    assert got == components_of(documents(), words, 80)


def test_neardup_keeps_one(spark, docs, none):
    kept = neardup.deduplicate(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {d for d, _, c in components_of(documents(), 5, 80) if d == c}
    assert len(ids) == len(set(ids)) and set(ids) - {None} == want - {None} and kept.columns == docs.columns
    assert neardup.link_classes(none).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + k, 201 + k) for k in range(30)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---- repeated strings
def test_suffix_arrays():
    rng = random.Random(7)
    for trial in range(25):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 5))]
        texts += [texts[0] + b"x" + texts[0]] * (trial % 2)
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        limits, raw = np.repeat(np.cumsum(sizes), sizes), b"".join(texts)
        order = suffix.suffix_array(data, limits)
        ends = [raw[p : limits[p]] for p in range(len(raw))]
        assert [ends[p] for p in order] == sorted(ends)
        shared = suffix.common_prefixes(data, limits, order, 20)
        for a, b in zip(order[:-1], order[1:], strict=True):
            x, y = ends[a][:20], ends[b][:20]
            k = next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
            assert shared[b] == k


@pytest.mark.parametrize("shard_bytes", [1 << 20, 500])
def test_repeats_by_brute_force(spark, none, shard_bytes, monkeypatch):
    monkeypatch.setattr(suffix, "MERGED", 64)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = []
    for k in range(40):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300)))
        if k % 3 == 0:
            a = rng.randint(0, 1200)
            t += base[a : a + rng.randint(20, 300)] + t[: rng.randint(0, 60)]
        if k % 5 == 0:
            t = list(base[500:900])
            t[rng.randrange(400)] = "Z"
            t = "".join(t)
        rows.append((k, {17: "xy" * 300, 19: None, 20: rows[3][1] if k > 3 else "", 21: ""}.get(k, t)))
    length, raw = 40, [(t or "").encode() for _, t in rows]
    counts = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "row_key", "of_row", "_spans", "_row_key", "_of")})
    got = {r["doc_id"]: r for r in suffix.remove_repeats(df, length=length, digest=True, shard_bytes=shard_bytes).collect()}
    for (k, _), t in zip(rows, raw, strict=True):
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[covered[:-1] == 0])
        want = (len(t), int(covered.sum()), int((np.diff(np.append(0, covered)) == 1).sum()), hashlib.sha256(kept).hexdigest())
        assert tuple(got[k])[1:] == want
    if shard_bytes == 500:
        assert suffix.remove_repeats(df, length=length).columns == df.columns
        assert suffix.remove_repeats(none, digest=True).count() == 0


# ---- fingerprints, licences
def test_fingerprints(spark, docs, none):
    got = collections.defaultdict(set)
    for r, t in zip(fingerprint.fingerprints(docs).collect(), [r["text"] for r in docs.collect()], strict=True):
        got[t or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in got.values()) and got[""] == {""}
    assert fingerprint.fingerprints(none).count() == 0
    text = " ".join(f"w{k % 37}x{k}" for k in range(300))
    words = text.split()
    pair = spark.createDataFrame([(1, text, " ".join(words[:290])), (2, text, " ".join(reversed(words))), (3, "", "a")], "i int, a string, b string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(pair, "a", "fa"), "b", "fb")
    near = {r["i"]: r["n"] for r in df.select("i", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("n")).collect()}
    assert near[1] > 0.6 and near[2] < 0.1 and near[3] == 0.0


def test_successor(spark):
    rows = [(k * 7 % 50, f"t{k}") for k in range(50)] + [(None, "n")]
    got = fingerprint.with_successor(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], "text")
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    want = dict(zip(order, order[1:] + order[:1], strict=True))
    assert {r["text"]: r["next_text"] for r in got.collect()} == want


def test_licences(spark, none):
    rows = [
        (1, "Intro.\nPERMISSION is hereby  granted" + license.SENTENCES["mit_grant"][28:] + "\nSomething else. " + license.SENTENCES["mit_condition"]),
        (2, "RELEASED under the  mit licence.\nReleased   under THE mit license."), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0. All rights reserved."),
        (6, license.SENTENCES["apache_notice"] + " " + license.SENTENCES["apache_compliance"]),
    ]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.lit(1))).collect()}
    assert [got[k]["licences"] for k in range(1, 7)] == ["MIT", "MIT", "", "", "CC-BY-NC-4.0,all-rights-reserved", "Apache-2.0"]
    assert got[6]["unmatched"] == "<apache_compliance>"
    assert license.scan(none).count() == 0


# ---- pages
def test_urls(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    rows = [
        (1, "https://a.example.org/es/x", ""), (2, "http://other.net/p?utm_source=y#top", link.format("https://a.example.org/es/x")), (3, "https://www.OTHER.net/p/", None),
        (4, "http://x.com/fr/1", link.format("/de/2")), (5, "http://x.com/de/2", None), (6, "http://x.com/elsewhere", '<META http-equiv="refresh" content="0; url=http://x.com/de/2">'),
        (7, None, None), (8, "no url", None), (9, "https://notexample.org/es/", ""), (10, "http://far.net/", link.format("")), (1, "https://a.example.org/es/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("z")).withColumn("node", F.lit("z"))
    rules = spark.createDataFrame(urls.RULES, "rule string, action string")
    got = collections.defaultdict(set)
    for r in urls.judge(pages, rules).collect():
        got[r["page_id"]].add((r["host"], r["rule"], r["verdict"]))
    assert got[1] == {("a.example.org", "example.org/es/", "block")}
    assert got[2] == {("other.net", None, "block")} and got[3] == {("www.other.net", None, "block")}
    assert got[4] == {("x.com", "com/fr/", "allow")} and got[5] == {("x.com", "com/de/", "block")}
    assert got[6] == {("x.com", None, "allow")}  # an alias is allowed, which comes before the block
    assert got[7] == got[8] == {("", None, "allow")} and got[9] == {("notexample.org", "org/", "allow")} and got[10] == {("far.net", None, "allow")}
    assert urls.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_warc_round_trip(spark, tmp_path, compress):
    rows = [(k, f"http://h/{k}", ["<p>é</p>\r\n\r\nWARC/1.1\r\n", "x" * 5000, None, ""][k % 4]) for k in range(12)] + [(3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write(pages, str(tmp_path / "w"), compress=compress, rows_per_file=4)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    for r in got:
        k = int(r["record_id"].rsplit(":", 1)[1])
        body = (dict((a, c) for a, _, c in rows)[k] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        first = min(a for a, _, c in rows if (c or "").encode() == body)
        assert r["refers_to"] == (None if k == first else f"urn:page:{first}") and r["type"] == ("response" if k == first else "revisit")
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def record(k, body):
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{k}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_salvage_of_damage():
    import gzip

    parts = [record(k, bytes([65 + k]) * 50) for k in range(4)]
    found = lambda data: [(k, o, n, w["record_id"] if k == "record" else None) for k, o, n, w in warc.salvage(data)]
    broken = parts[1].replace(b"BBBB", b"BxBB", 1)
    got = found(parts[0] + broken + parts[2])
    assert [g[3] for g in got] == ["r0", None, "r2"] and got[1][1:3] == (len(parts[0]), len(broken))
    got = found(parts[0] + parts[1][:-20] + parts[2] + b"junk")
    assert [g[3] for g in got] == ["r0", None, "r2", None] and got[-1][2] == 4
    zipped = [gzip.compress(p, mtime=0) for p in parts]
    bad = zipped[1][:20] + b"\xff\xff" + zipped[1][22:]
    got = found(zipped[0] + bad + zipped[2] + parts[3])
    assert [g[3] for g in got if g[0] == "record"] == ["r0", "r2", "r3"] and sum(g[0] == "gap" for g in got) == 1
    assert found(b"") == [] and [g[0] for g in found(b"nothing")] == ["gap"]


def test_word_spans_stop_at_texts():
    data, offsets = kernels.utf8(__import__("pyarrow").array(["ab", "cd e", None, ""]))
    starts, ends, ptr = kernels.word_spans(data, offsets)
    assert (starts.tolist(), ends.tolist(), ptr.tolist()) == ([0, 2, 5], [2, 4, 6], [0, 1, 3, 3, 3])


def test_filters_go_by_row(spark):
    rng = random.Random(12)
    words = ["the", "and", "there", "hand", "tree", "reed", "here", "then", "near", "hat"]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    clean = [(k, text(), "en", "s", 0) for k in range(30)] + [(None, text(), "en", "s", 0) for _ in range(20)] + [(5, text(), "en", "s", 0), (5, text(), "de", "s", 0)]
    bad = [(None, None, "en", "s", 0), (None, "short", "en", "s", 0), (5, "short", "en", "s", 0), (7, None, None, "s", 0)]
    df = spark.createDataFrame(clean + bad, SCHEMA)
    assert sorted(map(repr, map(tuple, quality.quality_filter(df).collect()))) == sorted(map(repr, clean))
    copies = [(None, clean[3][1], "en", "s", 0), (None, clean[35][1], "en", "s", 0), (5, clean[35][1], "en", "s", 0), (9, clean[9][1], "en", "s", 0)]
    left = neardup.deduplicate(spark.createDataFrame(clean + copies, SCHEMA).withColumn("who", F.lit(1))).drop("who")
    want = [r for r in clean if r != clean[35]] + [(5, clean[35][1], "en", "s", 0)]
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, want))


def test_salvage_of_written_archives(spark, tmp_path):
    import gzip
    import pathlib

    rng = random.Random(13)
    rows = [(k, f"http://h/{k}", "".join(rng.choice("abcdefgh é") for _ in range(3000))) for k in range(30)] + [(30, "http://h/30", "long " * 3_500_000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), compress=True)
    files = [f.read_bytes() for f in pathlib.Path(tmp_path / "w").glob("part-*")]
    ids = lambda data: [int(w["record_id"].rsplit(":", 1)[1]) for k, _, _, w in warc.salvage(data) if k == "record"]
    assert sorted(k for f in files for k in ids(f)) == list(range(31))
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 31
    data = max(files, key=lambda f: len(ids(f)))
    whole, at = ids(data), len(data) // 2
    damaged = ids(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
    assert len(whole) > 2 and set(damaged) < set(whole) and len(damaged) == len(whole) - 1
    cut_off = ids(data[: at + 1])
    assert cut_off == whole[: len(cut_off)] and len(cut_off) > 0
    # an archive of another writer, all in one member: what stands before the damage is read
    noise = [record(k, rng.randbytes(20_000)) for k in range(9)]
    one = gzip.compress(b"".join(noise), mtime=0)
    got = [(k, w["record_id"] if k == "record" else None) for k, _, _, w in warc.salvage(one[: len(one) // 2])]
    assert [w for _, w in got[:-1]] == ["r0", "r1", "r2", "r3"] and got[-1][0] == "gap"
    assert [w["record_id"] for k, _, _, w in warc.salvage(one[:-6] + b"\0" + one[-5:]) if k == "record"] == [f"r{k}" for k in range(9)]


def test_wrapped_licences(spark):
    import textwrap

    known = license.SENTENCES | license.MORE_SENTENCES
    wrap = lambda prefix, *ids: f"\n{prefix.rstrip()}\n".join(textwrap.fill(known[i], 70, initial_indent=prefix, subsequent_indent=prefix) for i in ids)
    rows = [
        ("MIT", "/*\n" + wrap(" * ", "mit_grant", "mit_condition") + "\n */\nint x;"),
        ("GPL-3.0-or-later", wrap("# ", "gpl_grant", "gpl_warranty")),
        ("Apache-2.0", "\n".join(wrap("// ", i) for i in ("apache_header", "apache_compliance", "apache_copy")) + "\n//\n//     http://x.org/LICENSE-2.0\n//\n" + wrap("// ", "apache_basis")),
        ("BSD-3-Clause", wrap("", "bsd_grant") + "\n\n1. " + wrap("   ", "bsd_source").strip() + "\n2) " + wrap("   ", "bsd_binary").strip() + "\n\n3. " + wrap("   ", "bsd_endorse").strip()),
        ("MIT", known["mit_grant"] + " " + known["mit_condition"]),
        ("MIT", wrap("", "mit_grant", "mit_condition").replace("\n", "\r\n")),
        ("ISC", wrap("-- ", "isc_grant")), ("LGPL-2.1-or-later", wrap("; ", "lgpl21_grant")),
        ("", "Released under\n\nthe MIT License."), ("", "All rights. Reserved."), ("", "Never released under the MIT License."), ("", "Released under the MIT License and others"),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in license.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
    every = spark.createDataFrame([(i, wrap("# ", i)) for i in known], "doc_id string, text string")
    assert {r["doc_id"]: r["sentence_ids"] for r in license.scan(every).collect()} == {i: f"<{i}>" for i in known}


# ---- brute force beside the operators
def test_fingerprints_by_brute_force(spark):
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def h(*parts):
        seed = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else struct.pack("<q", p) if isinstance(p, int) else struct.pack("<i", p[0])
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
        return signed(seed)

    def brute(text):
        tokens = [h(w) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
        grams = [h(a, b) for a, b in zip(tokens, tokens[1:], strict=False)] or ([h(*tokens)] if tokens else [])
        seen, numbered = collections.Counter(), []
        for at, x in enumerate(grams):
            high = x >> fingerprint.PLACE_BITS
            numbered.append((h(high, (seen[high],)) >> fingerprint.PLACE_BITS, at))
            seen[high] += 1
        classes = collections.defaultdict(list)
        for e, at in numbered:
            classes[(e >> (64 - fingerprint.PLACE_BITS - fingerprint.BUCKET_BITS)) & 31].append((e, at))
        out = []
        for c, members in classes.items():
            least = sorted(sorted(members)[: fingerprint.LEAST], key=lambda m: m[1])
            out.append(f"{c:02x}{h(*[e for e, _ in least]) & ((1 << 64) - 1):016x}")
        return ".".join(sorted(out))

    rng = random.Random(8)
    texts = ["", "one", "a b a b a b a", "x " * 500, "é" * 40, " \n"] + [" ".join(rng.choice(["aa", "bb", "c", "ddd", "é", "x" * 20]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {k: brute(t) for k, t in enumerate(texts)}


def test_repeats_at_full_length(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    long, short = prose(90), prose(45)  # passages of over 50 words, one of over 400 bytes and one below
    assert len(long) > 450 and len(short) < 400
    rows = [(k, prose(30) + " " + (long if k % 3 == 0 else short if k % 3 == 1 else prose(60)) + " " + prose(40)) for k in range(60)]
    rows += [(100, long * 2), (101, long[:399]), (102, "ab" * 5000), (103, prose(200_000))]  # the last is over one block
    raw = [t.encode() for _, t in rows]
    counts = collections.Counter()
    for t in raw:
        counts.update({hash(t[i : i + 400]) for i in range(len(t) - 399)} if len(t) > 100_000 else [hash(t[i : i + 400]) for i in range(len(t) - 399)])
    for shard_bytes in (1 << 20, 4000):
        got = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True, shard_bytes=shard_bytes).collect()}
        for (k, _), t in zip(rows, raw, strict=True):
            step = np.zeros(len(t) + 1, int)
            for i in range(len(t) - 399):
                if counts[hash(t[i : i + 400])] > 1:
                    step[i] += 1
                    step[i + 400] -= 1
            covered = np.cumsum(step)[:-1] > 0
            kept = bytes(np.frombuffer(t, np.uint8)[~covered])
            assert (got[k]["n_removed"], got[k]["kept_sha256"]) == (int(covered.sum()), hashlib.sha256(kept).hexdigest()), k


def test_kneser_ney_by_plain_counts():
    rng = np.random.default_rng(4)
    symbols, order = 5, 3
    text = rng.integers(1, symbols, 900).tolist()
    grams = [tuple(text[i : i + order]) for i in range(len(text) - order + 1)]
    tables = {order: collections.Counter(grams)}
    for k in (2, 1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])

    def plain(gram):
        k = len(gram)
        if not k:
            return 1 / symbols
        n1, n2, n3, n4 = (max(1, sum(c == j for c in tables[k].values())) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0, *(min(max(x, 0.05), most) for x, most in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))]
        same = {g: c for g, c in tables[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return plain(gram[1:])
        total = sum(same.values())
        c = same.get(gram, 0)
        return (c - d[min(c, 3)] * (c > 0)) / total + sum(d[min(x, 3)] for x in same.values()) / total * plain(gram[1:])

    number = lambda g: sum(x * symbols ** (len(g) - 1 - i) for i, x in enumerate(g))
    model = quality.KneserNey(np.array([number(g) for g in tables[order]]), np.array(list(tables[order].values())), symbols, order)
    asked = [tuple(rng.integers(0, symbols, order).tolist()) for _ in range(200)]
    assert np.allclose(model.lookup(order, np.array([number(g) for g in asked])), [plain(g) for g in asked])


def test_quality_bits_follow_from_all_texts(spark):
    """The distributed shards give what one model of all texts gives."""
    rng = random.Random(6)
    words = ["the", "and", "über", "hand", "tree", "日本", "here", "then", "***"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))), ["en", "de", None][k % 3], "s", 0) for k in range(90)] + [(200, "", "en", None, 0), (201, None, None, None, None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for lang in ("en", "de", None):
        mine = [(k, t) for k, t, x, *_ in rows if x == lang]
        data, offsets = kernels.utf8(__import__("pyarrow").array([t for _, t in mine]))
        grams, back, counts = np.unique(quality.codes(data, offsets), return_inverse=True, return_counts=True)
        bits = quality.KneserNey(grams, counts).surprisal(grams)[back]
        base = quality.base_counts(data, offsets)
        for i, (k, _) in enumerate(mine):
            letters = max(1, int(base["word_chars"][i] - base["n_symbols"][i]))
            assert abs(got[k]["bits"] - bits[offsets[i] : offsets[i + 1]].sum() / letters) < 1e-3 * (1 + got[k]["bits"])


def test_packed_numbers_are_small_and_whole():
    rng = np.random.default_rng(3)
    counts, grams = rng.geometric(0.3, 5000), np.unique(rng.integers(0, quality.MODEL, 5000))
    bits = rng.random(5000).astype(np.float32) * 20
    for x in (counts, counts[:1], counts[:0], bits):
        assert (quality._unpack(quality._pack(x), x.dtype.type, len(x)) == x).all()
    assert (quality._unzip(quality._zip(grams), np.int64, len(grams)) == grams).all()
    batch = pa.record_batch([pa.array(["".join(map(chr, rng.integers(97, 107, 400))) for _ in range(200)])], names=["text"])
    n = quality._block_grams(batch, "text", np.zeros(200, np.int64))[1]
    plain = len(pa.compress(np.diff(n, prepend=0).tobytes(), codec="zstd", asbytes=True))
    assert len(quality._pack(n)) < 0.7 * plain


def test_toxicity_scorer_equals_its_sentences():
    rng = random.Random(3)
    words = ["blockhead", "tree", "hand", "a", "b", "é", "num-skull", "***", "end.", "so!", "_"]
    texts = ["", " \n", "b l o c k h e a d", "b  l o\nc"] + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(1, 130))) for _ in range(80)]
    clean = [" ".join(rng.choice(words[1:3]) for _ in range(12)) for _ in range(40)]
    machine = toxicity.train(clean + [c + " blockhead" for c in clean] + [c + " numskull" for c in clean], [0] * 40 + [1] * 80)
    data, offsets = kernels.utf8(__import__("pyarrow").array(texts))
    got = toxicity.Scorer(machine).margins(data, offsets)
    for t, m in zip(texts, got, strict=True):
        parts = [float(machine.shares(s).sum()) if s else 0.0 for s in toxicity.sentences(t)]
        assert abs(m - machine.bias - max(parts, default=0.0)) < 1e-6


def test_neardup_finds_links_near_the_limit(spark):
    """Documents of one family around a similarity of 0.8: components by brute force, in cells of several chunks."""
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for family in range(4):
        base = [rng.choice(vocabulary) for _ in range(160)]
        for _ in range(60):
            words = list(base)
            for at in rng.sample(range(160), rng.randint(2, 26)):
                words[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    neardup_chunk, neardup.CHUNK = neardup.CHUNK, 16
    try:
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.link_classes(df, words=2).collect()), key=repr)
    finally:
        neardup.CHUNK = neardup_chunk
    assert got == components_of(rows, 2, 80)


def test_filters_take_any_column_name(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["the", "and", "tree", "hand", "reed", f"u{k}"]) for _ in range(40)), "en", "s", 0) for k in range(30)]
    odd = ("judged_key", "kept_key", "kept_row", "_of", "_spans", "_row_key", "spans", "block", "shard", "x", "y", "key", "row", "node", "signature", "who", "class", "_key", "_text")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in odd})
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for out in (quality.quality_filter(df), neardup.deduplicate(df), suffix.remove_repeats(df), toxicity.toxicity_filter(df, labels)):
        assert out.columns == df.columns and 0 < out.count() <= 30

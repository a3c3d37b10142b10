"""The pipeline's stages on a small fixture: what goes, what stays, and the columns."""

import random

import corpus_pipeline
from groundline.llm import kernels, suffix, tables


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("ethanidrosl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(90))
    passage = text() + " " + text()
    rows, labels = [], []
    for k in range(150):
        words = text().split(" ")
        if k % 5 == 0:
            words[11] = rng.choice(["blockhead", "numskull"])
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(k % 5 == 0)))
    copy = rows[7][1]
    rows += [(500, copy + " more", "en", "s", 0), (501, None, None, None, None), (502, "", "en", "s", 0), (503, text() + " " + passage, "en", "s", 0), (504, text() + " " + passage + " " + text(), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(range(150)) | {500, 503, 504} == set(kept["quality"])
    toxic = {k for k, _, t in labels if t}
    assert len(toxic & set(kept["toxicity"])) <= 1 and len(set(kept["quality"]) - toxic - set(kept["toxicity"])) <= 3
    assert 500 not in kept["neardup"] and set(kept["toxicity"]) - {500} == set(kept["neardup"])
    assert set(kept["suffix_dedup"]) == set(kept["neardup"])
    for k in {503, 504} & set(kept["suffix_dedup"]):
        r = kept["suffix_dedup"][k]
        assert passage not in r["text"] and r["n_chars"] == len(r["text"])
    assert {r for r in kept["packing"]} == set(kept["suffix_dedup"])


def test_stages_hand_over_parquet(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    read_from = []

    def stage(spark, docs, sf_dir):
        read_from.append(docs.inputFiles())
        return docs.filter(f"doc_id <> {len(read_from)}")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", stage) for k in range(4)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 5]
    assert all(files and all(f.endswith(".parquet") for f in files) for files in read_from)
    assert all(f"/{k}-s{k - 1}/" in f for k, files in enumerate(read_from) if k for f in files)


def test_passages_of_many_short_words_go(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(n))
    many, fewer, long = prose(55), prose(45), "".join(rng.choice("abcdef") for _ in range(450))
    assert 200 < len(many) < 400 and 200 < len(fewer) < 400
    begin, end = [prose(30) + str(k) for k in range(7)], ["<>{}[]~"[k] + prose(30) for k in range(7)]
    shared = [many, many, fewer, fewer, long, long, prose(55)]
    rows = [(k, f"{begin[k]} {shared[k]} {end[k]}", 0) for k in range(7)] + [(7, None, None)]
    out = corpus_pipeline.suffix_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[k] for k in (0, 1, 4, 5)] == [begin[k] + end[k] for k in (0, 1, 4, 5)]
    assert [got[k] for k in (2, 3, 6, 7)] == [rows[k][1] for k in (2, 3, 6, 7)]
    assert [suffix.whole_words(b"one two three", a, b) for a, b in ((0, 13), (1, 13), (0, 12), (3, 8), (5, 6))] == [3, 2, 2, 1, 0]


def test_stages_begin_without_what_others_left(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = full()
    corpus_pipeline.prepared(spark)
    assert full() > before
    kernels.worker_cache("tables of one operator", dict)
    kernels.forget()
    assert not kernels._worker
    tables.shrink(spark)

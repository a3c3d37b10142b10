"""Order MinHash fingerprints, in DataFrame operations only.

Tokens are words (runs without ASCII white space, cut after 16 characters, so unspaced text has tokens too); a k-mer is
GRAM tokens. Each k-mer is numbered by its earlier occurrences in the text; the hashes of numbered k-mers are dealt to
BUCKETS classes by their highest bits, and of each class the LEAST minimal ones are kept, put back into text order and
hashed as a tuple. A tuple survives only if its k-mers do, in the same order, so likeness follows edit distance, not just
common content. One hash dealt to classes stands for one permutation each.

All steps are array functions over one row: work is n log n in a text's length, and nothing is moved but the text itself,
once, to stand beside its successor.

Null texts are empty; an empty text has the empty fingerprint, whose likeness to another empty one is 1 and to any other
0. Fewer tokens than a k-mer has are one k-mer. Equal texts have equal fingerprints. Rows with equal ids follow each other
in order of their texts; null ids come last; one row alone is its own successor. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.llm.tables import read

GRAM = 2
BUCKET_BITS = 5
LEAST = 2
#: Bits of a long that hold a k-mer's place; the others are of its hash.
PLACE_BITS = 28
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Ranges of ids that are dealt out for the successor; a bound on what the driver gets.
RANGES = 2048


def _shifted(a: Column, by: int, size: Column, none: Column) -> Column:
    """The element ``by`` places before each one; none at the start."""
    return F.concat(F.array_repeat(none, by), F.slice(a, F.lit(1), F.greatest(size - by, F.lit(0))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """All columns of df and the array of a text's tuple hashes, each written with its class.

    Arrays hold plain longs, a hash in the high bits and the place in the text in the low PLACE_BITS, so they are sorted as
    numbers. Temporary columns begin with ``_omh_``. Every array that a step reads twice is a column of its own, so no step
    is evaluated again for each element.
    """
    t = lambda name: f"_omh_{name}"
    c = lambda name: F.col(t(name))
    n, none = F.size, F.lit(None).cast("long")
    place = (1 << PLACE_BITS) - 1
    packed = lambda h, at: h.bitwiseAND(F.lit(~place)).bitwiseOR(at)
    high = lambda x: F.shiftright(x, PLACE_BITS)
    at = lambda x: x.bitwiseAND(F.lit(place))
    df = df.withColumn(t("h"), F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w)))
    grams = c("h")
    for k in range(1, GRAM):
        grams = F.zip_with(F.slice(grams, F.lit(1), n(c("h")) - k), F.slice(c("h"), F.lit(1 + k), n(c("h"))), lambda a, b: F.xxhash64(a, b))
    whole = F.when(n(c("h")) > 0, F.array(F.xxhash64(c("h")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(t("x"), F.when(n(c("h")) >= GRAM, grams).otherwise(whole))
    # equal k-mers stand together, in text order
    df = df.withColumn(t("s"), F.sort_array(F.transform(c("x"), lambda x, i: packed(x, i.cast("long")))))
    df = df.withColumn(t("b"), _shifted(c("s"), 1, n(c("s")), none))
    number = lambda x, o: packed(F.xxhash64(high(x), o), at(x))
    again = lambda a, b: b.isNotNull() & (high(a) == high(b))
    first = F.filter(F.zip_with(c("s"), c("b"), lambda a, b: F.when(~again(a, b), number(a, F.lit(0)))), lambda x: x.isNotNull())
    later = F.filter(F.zip_with(c("s"), c("b"), lambda a, b: F.when(again(a, b), a)), lambda x: x.isNotNull())
    df = df.withColumn(t("f"), first).withColumn(t("d"), later)
    # the k-mers that stood before: runs of equal ones, numbered on from 1
    begins = F.filter(F.zip_with(F.sequence(F.lit(0), n(c("d"))), F.zip_with(c("d"), _shifted(c("d"), 1, n(c("d")), none), lambda a, b: ~again(a, b)), lambda i, f: F.when(f, i)), lambda i: i.isNotNull())
    df = df.withColumn(t("r"), F.when(n(c("d")) > 0, begins).otherwise(F.array().cast("array<int>")))
    runs = F.zip_with(c("r"), F.concat(F.slice(c("r"), F.lit(2), F.greatest(n(c("r")) - 1, F.lit(0))), F.array(n(c("d")))), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    counted = F.flatten(F.transform(runs, lambda r: F.transform(F.slice(c("d"), r.a + 1, r.n), lambda v, o: number(v, o + 1))))
    df = df.withColumn(t("u"), F.sort_array(F.when(n(c("d")) > 0, F.concat(c("f"), counted)).otherwise(c("f"))))
    # of each class the LEAST minimal ones: those that have fewer than LEAST of their class before them
    bucket = lambda e: F.shiftrightunsigned(e, 64 - BUCKET_BITS)
    least = F.zip_with(c("u"), _shifted(c("u"), LEAST, n(c("u")), none), lambda a, b: F.when(b.isNull() | (bucket(a) != bucket(b)), a))
    df = df.withColumn(t("v"), F.filter(least, lambda v: v.isNotNull()))
    # tuples in text order, hashed; an element that begins a class stands for it
    if LEAST != 2:
        raise ValueError("tuples of two are written out here")
    before, after = lambda i: F.get(c("v"), i - 1), lambda i: F.get(c("v"), i + 1)
    begins_class = lambda a, i: (i == 0) | (bucket(before(i)) != bucket(a))
    pair = lambda a, b: F.when(at(a) < at(b), F.xxhash64(high(a), high(b))).otherwise(F.xxhash64(high(b), high(a)))
    tuple_of = lambda a, i: F.when(after(i).isNotNull() & (bucket(after(i)) == bucket(a)), pair(a, after(i))).otherwise(F.xxhash64(high(a)))
    written = F.transform(c("v"), lambda a, i: F.when(begins_class(a, i), F.concat(F.lpad(F.hex(bucket(a)), 2, "0"), F.lpad(F.hex(tuple_of(a, i)), 16, "0"))))
    df = df.withColumn(out, F.array_sort(F.filter(written, lambda x: x.isNotNull())))
    return df.drop(*[t(k) for k in ("h", "x", "s", "b", "f", "d", "r", "u", "v")])


def likeness(a: Column, b: Column) -> Column:
    """The share of classes with equal tuples, of all classes that either fingerprint has."""
    classes = lambda f: F.transform(f, lambda x: F.substring(x, 1, 2))
    union = F.size(F.array_union(classes(a), classes(b)))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def as_text(f: Column) -> Column:
    return F.lower(F.array_join(f, "."))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(-1)).otherwise(tree(0, len(cuts)))


def with_successor(df: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """All columns of df and ``next_<column>`` of the row that follows in descending order of key; the first follows the last.

    Rows are dealt out by ranges of the key that hold about as many rows each; only a range's last row looks elsewhere,
    for the first row of the next range, of which there are at most RANGES + 1.
    """
    spark = df.sparkSession
    ranges = max(1, min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)] or [0.5], 10_000).alias("c")).first()["c"]
    placed = df.withColumn("_range", _range_of(F.col(key), sorted(set(cuts or []))))
    tops = [(r["_range"], r["top"]) for r in placed.groupBy("_range").agg(F.max(key).alias("top")).orderBy(F.desc("_range")).collect()]
    if not tops:
        return df.withColumns({f"next_{c}": F.col(c) for c in columns})
    following = [(r, tops[(i + 1) % len(tops)][1]) for i, (r, _) in enumerate(tops)]
    is_top = F.col(key).isin([t for _, t in tops if t is not None]) | F.col(key).isNull()
    first = df.filter(is_top).groupBy(F.col(key).alias("_top")).agg(F.min_by(F.struct(*[F.col(c).alias(f"_first_{c}") for c in columns]), tie).alias("_f")).select("_top", "_f.*")
    links = spark.createDataFrame(following, f"_range int, _top {df.schema[key].dataType.simpleString()}")
    links = links.join(first, links["_top"].eqNullSafe(first["_top"])).select("_range", *[f"_first_{c}" for c in columns])
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last(key), F.asc(tie))
    led = placed.withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns})
    led = led.join(links, "_range", "left")
    return led.select(*df.columns, *[F.coalesce(f"_next_{c}", f"_first_{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row of docs."""
    df = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return with_fingerprint(df, "_text", "_f").select(key, as_text(F.col("_f")).alias("fingerprint"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_successor(with_fingerprint(docs, "text", "print"), "doc_id", ["text", "print"], "text")
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    df = with_fingerprint(df.drop("text", "next_text"), "edited", "edited_print")
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )

"""Mixing sources to target weights: hash-random keys, ranges of keys within each source, prefix sums of word counts by
range, and a cut at each source's exact budget.

All of it is DataFrame code. Keys are uniform, so equal spans of the key space are the ranges: a source with n documents
gets about n / RANGE_ROWS of them, and no task holds more than a few ranges of any source, however hot. The sums of the
ranges, a small table, give the offsets; within a range a window adds the rest.

Defined cases: a null or blank text has size 0 and is taken for 0 words. Documents without a source form one source, the
last. Where all sizes are 0, all targets are 0. Rows that share a doc_id, or have none, have keys by their texts. Only rows
equal in both have equal keys; they stand next to each other in the order, each taken on its own, and in one range. The
table of sources, a row for each, is handled by one task: thousands of sources, not millions. Very long texts are counted
and cut whole. An empty table gives no rows. Other columns are passed on untouched by mixture(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stage import materialize

#: Weights of the sources in the order of their names, repeating; share of all words that the mix has; epochs at most.
WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2
#: Documents of a source in one range of keys, about; ranges are a power of two, so that spans stay exact.
RANGE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources: source and source_size. Adds target: the words by weight, none above epochs times its source's size.

    Handing on the excess by weight until none is above ends where every target is the less of its cap and weight times
    one common level. In the order of cap / weight the capped sources come first, so running sums give that level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("w", pick).withColumn("cap", F.col("source_size").cast("double") * epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double") * share).withColumn("all_w", F.sum("w").over(everything))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # left / open_w rises while sources are capped and falls once they are not, so its largest value is the level.
    s = s.withColumn("level", left / open_w).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def plan(docs: DataFrame, order: list[str], measured: DataFrame | None = None, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """docs: source, size and key (hex digits of a hash). Adds source_size, target, whole, extra and taken, in the place of
    columns with these names; all others stay.

    ``order`` breaks ties of keys; ``measured`` is a narrow copy of the same rows, where docs is dear to compute. Words
    before a document in its source, in the order of keys, settle what it gives: all of it once for each whole epoch, and
    as much of it as the rest of the budget still holds.
    """
    narrow = (docs if measured is None else measured).select("source", "size", "key")
    sized = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    spans = F.pow(F.lit(2.0), F.least(F.greatest(F.ceil(F.log2(F.col("_n") / F.lit(float(RANGE_ROWS)))), F.lit(0)), F.lit(30))).cast("long")
    names = sized.select(F.col("source").alias("_s"), spans.alias("_spans"))
    known = targets(sized.select("source", "source_size"), weights, share, epochs)
    known = materialize(known.join(names, F.col("source").eqNullSafe(F.col("_s"))).drop("source"), "mix-targets")
    ranged = lambda df: df.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("_spans"), 32))
    sums = ranged(narrow).groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_offset")), "mix-offsets")
    made = ["source_size", "target", "whole", "extra", "taken"]
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *dict.fromkeys(["source", "size", "key", *order]))
    d = ranged(boxed).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    within = Window.partitionBy("source", "_range").orderBy("key", *order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target")
    d = d.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
    rest = budget - F.col("whole") * F.col("source_size")
    d = d.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - before)))
    d = d.withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made], *made)


def random_key(doc_id: Column, text: Column) -> Column:
    """Hex digits of a hash of id and text, so that no number of rows without an id shares a key."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key"))
    return plan(materialize(narrow, "mix-sizes"), ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by window functions over whole sources; DuckDB.
SQL3 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             source_size::DOUBLE * 2 AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0.0)) / (all_w - coalesce(sum(w) OVER b, 0.0)) AS lv FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, cap, w, max(lv) OVER () AS level FROM l),
g AS (SELECT source, source_size, least(cap, w * level) AS target FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size)::BIGINT ELSE 0 END AS whole
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM p
"""


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each epoch that takes it whole, and the one at a
    budget's end cut after its last word that still fits (n_chars, if there, then counts the cut text)."""
    names = docs.columns
    key = random_key(F.col("row.doc_id"), F.col("row.text"))
    boxed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")).select("row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), key.alias("key"))
    measured = materialize(boxed.select("source", "size", "key"), "mix-sizes")
    d = plan(boxed.withColumn("id", F.col("row.doc_id")), ["id", "size"], measured, weights, share, epochs).filter("taken > 0")
    d = d.withColumn("_upto", F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("extra").cast("string"), F.lit("}+")))
    cut = F.expr("regexp_extract(row.text, _upto, 0)")
    part = F.when(F.col("extra") == F.col("size"), F.array(F.col("row.text"))).when(F.col("extra") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))
    copies = d.select("row", F.explode(F.concat(F.array_repeat(F.col("row.text"), F.col("whole").cast("int")), part)).alias("text"))
    as_is = lambda n: F.when(F.length("text") == F.length("row.text"), F.col(f"row.`{n}`")).otherwise(F.length("text")).alias(n)
    return copies.select(*[F.col("text") if n == "text" else as_is(n) if n == "n_chars" else F.col(f"row.`{n}`").alias(n) for n in names])

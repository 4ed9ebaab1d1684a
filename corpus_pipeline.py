"""From documents to token ids: quality rules, toxicity, near duplicates, the mix of sources, BPE.

Each stage works on all rows that the one before kept, as read again from the Parquet that it wrote. All but the last
return the columns of documents, whatever further ones the table has.

Defined cases: a null or blank text fails the quality rules. Rows without a doc_id pass the near-duplicate stage. Rows that
share a doc_id are one document to it: all its rows stay or go together, but of rows with one doc_id and one text only the
first by the hash of all columns stays. Ties between copies go to the smaller doc_id. Very long texts go through every stage
whole. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, near_dup, quality_rules, toxicity
from factloom.llm.textvec import fresh
from factloom.plans.stage import discard, made_within, materialize, read_table

#: Near duplicates of the pipeline: Jaccard of word shingles of 0.8 and more. The 85 of near_dup is op10's contract alone.
PERCENT = 80
#: Words that a BPE worker keeps here: fewer than op5's, for idle workers hold them through the stages of the next run.
WORDS = 30_000


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    name = fresh("_quality", docs.columns)
    return quality_rules.judge(docs, name).filter(f"`{name}`.kept").select(*_columns(docs))


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by the classifier, which learns from the labelled ones among them."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    name = fresh("_toxic", docs.columns)
    return model.scored(docs, name).filter(F.col(name) < 0.5).select(*_columns(docs))


def distinct(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; all without a doc_id."""
    judged = materialize(near_dup.near_duplicates(docs.select("doc_id", "text"), percent=PERCENT), "judged")
    named, own, copy = docs.filter("doc_id IS NOT NULL"), fresh("_own", docs.columns), fresh("_copy", docs.columns)
    # What goes is a small part, and so are the rows that repeat a doc_id: only these move by what their text says.
    removed = judged.filter("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    kept = named.join(removed, named["doc_id"].cast("long") == removed[own], "left_anti")
    several = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(own))
    lost = docs.filter("doc_id IS NULL")
    if several.isEmpty():
        return kept.unionByName(lost)
    once = kept.join(several, kept["doc_id"].cast("long") == several[own], "left_anti")
    again = kept.join(several, kept["doc_id"].cast("long") == several[own], "left_semi")
    order = Window.partitionBy("doc_id", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.xxhash64(*_columns(docs)))
    again = again.withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).select(*_columns(docs))
    return once.unionByName(again).unionByName(lost)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken."""
    return mixing.mixture(docs)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    return bpe.digests(bpe.encoded(docs, keep=["doc_id"], words=WORDS))


_before: list[DataFrame] = []


def _staged(stage):
    """The stage, which first deletes what the one before wrote for itself: that one's rows are written by now."""

    def staged(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_before)
        _before.clear()
        with made_within() as tables:
            out = stage(spark, docs, sf_dir)
        _before.extend(tables)
        return out

    return staged


#: A stage's rows must be written before the next stage is called, as run() does.
STAGES = [("quality rules", _staged(quality)), ("toxicity", _staged(clean)), ("near duplicates", _staged(distinct)), ("mix", _staged(mixed)), ("bpe", _staged(tokens))]
#: SQL cannot express the label model, the trees or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input goes when its output is written, and what it wrote for itself soon after."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        docs = last = out
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

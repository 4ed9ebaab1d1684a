"""Program facts derived from the star-schema tables: functions are parts, calls follow each other in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.stage import read_table

#: Line items of this quantity and more make facts, where a query does not ask for all of them (least=None).
QUANTITY = 46


def lines(spark: SparkSession, sf_dir: str, least: int | None = QUANTITY) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return rows if least is None else rows.filter(F.col("l_quantity") >= least)


def call_sites(spark: SparkSession, sf_dir: str, least: int | None = QUANTITY) -> DataFrame:
    """ord, pos (from 0), caller, callee (null where unresolved), epistemic and reason."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines(spark, sf_dir, least).select(
        F.col("l_orderkey").alias("ord"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"),
        F.when(F.col("l_returnflag") == "A", 2).otherwise(1).alias("epistemic"), F.col("l_linestatus").alias("reason"),
    )


def direct_calls(spark, sf_dir, least=QUANTITY) -> DataFrame:
    return call_sites(spark, sf_dir, least).filter("callee IS NOT NULL")


def call_edges(spark, sf_dir, least=QUANTITY) -> DataFrame:
    return direct_calls(spark, sf_dir, least).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "epistemic")


def accesses(spark, sf_dir, status: str, least=QUANTITY) -> DataFrame:
    """function, memory, offset, size and epistemic; status F for writes, O for reads."""
    rows = lines(spark, sf_dir, least).filter(F.col("l_linestatus") == status)
    return rows.select(F.col("l_partkey").alias("function"), F.col("l_suppkey").alias("memory"), F.col("l_linenumber").cast("long").alias("offset"), F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_returnflag") == "A", 2).otherwise(1).alias("epistemic"))


def flows(spark, sf_dir) -> DataFrame:
    """source and sink event types, and user, of events that follow each other."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("sink")).filter("sink IS NOT NULL")


def summary_items(spark, sf_dir, least=QUANTITY) -> DataFrame:
    """function, revision (old or new), component (1 calls, 2 memory effects) and item: the semantic fields of one fact."""
    rev = lambda c: F.when(F.col(c) == "F", "old").otherwise("new")
    calls = call_sites(spark, sf_dir, least).filter("callee IS NOT NULL").select(F.col("caller").alias("function"), rev("reason").alias("revision"), F.lit(1).alias("component"), F.concat_ws("|", "callee", "epistemic").alias("item"))
    memory = lines(spark, sf_dir, least).select(F.col("l_partkey").alias("function"), rev("l_linestatus").alias("revision"), F.lit(2).alias("component"), F.concat_ws("|", "l_suppkey", F.col("l_linenumber").cast("long")).alias("item"))
    return calls.unionByName(memory)


def dependencies(spark, sf_dir, least=QUANTITY) -> DataFrame:
    """consumer, producer and sensitivity (0 semantic, 1 evidence only): calls of a caller depend on effects of its callee."""
    return direct_calls(spark, sf_dir, least).select(F.col("caller").alias("consumer"), F.col("callee").alias("producer"), (F.col("epistemic") - 1).alias("sensitivity")).distinct()

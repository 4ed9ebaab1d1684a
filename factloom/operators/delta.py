"""Incremental operators: component digests, diffs, dependency index, change propagation and the worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.ids import field_list


def component_digests(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component, digest and item_count: SHA-256 of the sorted, length-prefixed items of a component.

    A component of a function is what one array holds; items of many functions never meet.
    """
    return items.groupBy(*keys, "component").agg(F.array_sort(F.collect_list("item")).alias("items")).select(*keys, "component", F.sha2(field_list(F.col("items")), 256).alias("digest"), F.size("items").alias("item_count"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component and change (added, removed, changed) of components whose digests differ."""
    a, b = old.select(*keys, "component", F.col("digest").alias("old_digest")), new.select(*keys, "component", F.col("digest").alias("new_digest"))
    both = a.join(b, [*keys, "component"], "full_outer")
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "component", "change")


def delta_flags(changes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, calls_changed and effects_changed."""
    return changes.groupBy(*keys).agg(F.bool_or(F.col("component") == 1).alias("calls_changed"), F.bool_or(F.col("component") == 2).alias("effects_changed"))


def users_of(dependencies: DataFrame, producer) -> DataFrame:
    return dependencies.filter(F.col("producer") == producer).select("consumer").distinct().orderBy("consumer")


def replace_for_keys(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current without the rows of the keys that incoming has, and incoming."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def latest(rows: DataFrame, keys: list[str], epoch: str, tie: str) -> DataFrame:
    """The row of the highest epoch of each key; ties by the smaller ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(epoch), tie)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming whose keys current lacks, one for each key."""
    return incoming.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys)


def external_changes(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """keys of current whose external hash is new or another than before; a first store counts as a change."""
    p = previous.select(*keys, F.col("external_hash").alias("before"))
    return current.join(p, keys, "left").filter(~F.col("external_hash").eqNullSafe(F.col("before"))).select(*keys)


def schedule_predecessors(changed: DataFrame, scc_edges: DataFrame) -> DataFrame:
    """target: each component that calls a changed one (src_scc, dst_scc), once."""
    return scc_edges.join(changed.withColumnRenamed("component", "dst_scc"), "dst_scc", "left_semi").select(F.col("src_scc").alias("target")).distinct()


def merge_work(items: DataFrame, keys: list[str]) -> DataFrame:
    """One item for each key: all delta ids in the order they came first, the least priority, the most attempts.

    items: keys, seq, delta_id, priority, attempts. A delta id counts at its first place, so copies do not pile up.
    """
    once = items.groupBy(*keys, "delta_id").agg(F.min("seq").alias("seq"), F.min("priority").alias("priority"), F.max("attempts").alias("attempts"))
    by = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "delta_id"))).alias("d"), F.min("priority").alias("priority"), F.max("attempts").alias("attempts"))
    return by.select(*keys, F.transform("d", lambda x: x["delta_id"]).alias("delta_ids"), "priority", "attempts")


def drain(work: DataFrame, keys: list[str]) -> DataFrame:
    """All items in the order that they pop: by priority, then key."""
    return work.orderBy("priority", *keys)


def orphans(states: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return states.join(members.select(key).distinct(), key, "left_anti")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one side only, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))

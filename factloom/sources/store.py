"""Stores on plain files: content-addressed objects, versioned snapshots with one pointer, strict TSV relations.

One writer at a time, as for any snapshot store without a transaction log. A snapshot is written whole under a new name and
becomes current by one small write, so readers see the old version or the new one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.lattice import MAY, MUST


def put_if_absent(store: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows that clash): objects (key, bytes) new to the store, and those whose key holds other bytes."""
    inside = incoming.groupBy("key").agg(F.count_distinct("bytes").alias("n")).filter("n > 1").select("key")
    have = store.select("key", F.col("bytes").alias("had"))
    other = incoming.join(have, "key").filter(F.col("bytes") != F.col("had")).select("key")
    new = incoming.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti").join(inside, "key", "left_anti")
    return new, inside.union(other).distinct()


def objects_of(store: DataFrame, keys: DataFrame) -> DataFrame:
    """key, bytes and found for each distinct key asked: bytes are null where the store has no such object."""
    have = store.select("key", "bytes", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(have, "key", "left").select("key", "bytes", F.coalesce("found", F.lit(False)).alias("found"))


def append_batches(store: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts to append, batches that clash) of facts (run, batch, fact_id): a batch is taken whole or not at all.

    A batch that the store has is a replay and adds nothing; it clashes if its set of facts is another one.
    """
    key = ["run", "batch"]
    had, now = store.select(*key, "fact_id").distinct(), incoming.select(*key, "fact_id").distinct()
    new = incoming.distinct().join(had.select(*key).distinct(), key, "left_anti")
    both = had.select(*key).distinct().join(now.select(*key).distinct(), key, "left_semi")
    differ = had.subtract(now).unionByName(now.subtract(had)).select(*key).distinct()
    return new, differ.join(both, key, "left_semi")


def query_text(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """The rows of a statement with named parameters (:name), all columns as text."""
    rows = spark.sql(sql, args=parameters)
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


class Snapshots:
    """Named tables under a folder, each with versions and a pointer table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Writes all tables as one version and makes it current."""
        version = f"v{time.time_ns():020d}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        self.spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/_current")
        return version

    def current(self) -> str | None:
        """The last version that was published whole."""
        try:
            rows = self.spark.read.schema("version string, tables array<string>").parquet(f"{self.root}/_current")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows.agg(F.max("version")).first()[0]

    def read(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise LookupError("nothing has been published")
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")


def publish_checked(snapshots: Snapshots, summaries: DataFrame, graph_ids: DataFrame, tables: dict[str, DataFrame]) -> str:
    """Publishes only if the graph's summary ids are exactly the summaries'."""
    a, b = summaries.select("summary_id"), graph_ids.select("summary_id")
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("the graph and the summaries name different summary ids")
    return snapshots.publish(tables)


def write_relations(facts: DataFrame, folder: str) -> None:
    """One folder of tab-separated files for each relation, sorted by tuple id: columns, then the state."""
    for relation in [r[0] for r in facts.select("relation").distinct().collect()]:  # at most the relations of the schema
        rows = facts.filter(F.col("relation") == relation).sort("tuple_id")
        rows.select(F.concat_ws("\t", "columns", F.col("epistemic").cast("string")).alias("value")).write.mode("overwrite").text(f"{folder}/{relation}")


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """source, target and epistemic of strict three-field lines, merged to the weakest; any bad line is an error that names
    its file and text."""
    lines = spark.read.text(path).select(F.concat_ws(": ", F.input_file_name(), "value").alias("value"), F.split("value", "\t").alias("f"))
    bad = (F.size("f") != 3) | (F.get("f", F.lit(0)) == "") | (F.get("f", F.lit(1)) == "") | ~F.coalesce(F.get("f", F.lit(2)).isin(str(MUST), str(MAY)), F.lit(False))
    checked = lines.select(F.when(bad, F.raise_error(F.concat(F.lit("not a derived row: "), "value")).cast("array<string>")).otherwise(F.col("f")).alias("f"))
    rows = checked.select(F.col("f")[0].alias("source"), F.col("f")[1].alias("target"), F.col("f")[2].cast("int").alias("epistemic"))
    return rows.groupBy("source", "target").agg(F.max("epistemic").alias("epistemic"))

"""The change feed as a stream: deduplicated work items, upserted batch by batch into a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.delta import drain, merge_work
from factloom.sources.store import Snapshots

KEYS = ["kind", "target"]


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State and batch (kind, target, seq, delta_id, priority, attempts), one row for each key and delta id. A delta that was
    popped stays as done, so that a replayed batch does not bring it back."""
    batch = batch.withColumn("done", F.lit(False))
    both = batch if state is None else state.unionByName(batch)
    values = [F.min("seq").alias("seq"), F.min("priority").alias("priority"), F.max("attempts").alias("attempts"), F.max("done").alias("done")]
    return both.groupBy(*KEYS, "delta_id").agg(*values)


def run(feed: DataFrame, snapshots: Snapshots, checkpoint: str):
    """Starts the stream. A batch that is replayed folds to the same state, so each item counts once."""

    def upsert(batch: DataFrame, _: int) -> None:
        state = snapshots.read("work") if snapshots.current() else None
        snapshots.publish({"work": fold(state, batch.select(*KEYS, "seq", "delta_id", "priority", "attempts"))})

    return feed.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(snapshots: Snapshots) -> DataFrame:
    return merge_work(snapshots.read("work").filter("NOT done").drop("done"), KEYS)


def pop(snapshots: Snapshots, n: int = 1) -> list:
    """The n items of the least priority, ties by key, as rows; they are done from then on. Not while the stream writes."""
    items = drain(pending(snapshots), KEYS).limit(n).collect()
    if items:
        state = snapshots.read("work")
        taken = state.sparkSession.createDataFrame([(r["kind"], r["target"], d) for r in items for d in r["delta_ids"]], "kind string, target string, delta_id string")
        marked = state.join(taken.withColumn("now", F.lit(True)), [*KEYS, "delta_id"], "left")
        snapshots.publish({"work": marked.withColumn("done", F.col("done") | F.coalesce("now", F.lit(False))).drop("now")})
    return items


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by hour and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

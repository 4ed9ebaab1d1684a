"""Stage boundaries: tables written to the folder that every executor shares.

A stage boundary cuts the lineage, so that a lost executor costs a reread and not a recomputation. The folder is the one
the cluster names in spark.checkpoint.dir; only where that is unset (tests, a laptop) is one made here. The shuffle files
of a boundary go as soon as it is written, and the table itself when discard() is told that all who read it are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of an action go with it; a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Lists of the tables written within the calls of made_within() that are open.
_open: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[app] = f"{(named or 'file://' + tempfile.mkdtemp(prefix='factloom-')).rstrip('/')}/factloom-{app}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go as soon as it ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns a scan of what was written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _cleaned(spark):
        df.write.parquet(path)
    return _noted(spark.read.schema(df.schema).parquet(path), path)


def _noted(out: DataFrame, path: str) -> DataFrame:
    out.stage_path = path
    for tables in _open:
        tables.append(out)
    return out


@contextmanager
def made_within() -> Iterator[list[DataFrame]]:
    """A list that gets every table written within it, for discard() once nothing reads them any more."""
    tables: list[DataFrame] = []
    _open.append(tables)
    try:
        yield tables
    finally:
        _open.pop()


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Writes df once in buckets by ``key``, as many as shuffles have partitions, and returns a scan of it: joins and
    aggregations on the key then leave its rows where they lie."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "_".join(path.rpartition("/")[2].split("-"))
    with _cleaned(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.stage_table = table
    return _noted(out, path)


class Rounds:
    """A table that grows by parts: each is written once, and a reader of the whole sees all parts so far."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.parts, self.schema = spark, new_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df as the next part and returns a scan of it."""
        self.schema = self.schema or df.schema
        path = f"{self.path}/part={self.parts}"
        with _cleaned(self.spark):
            df.write.parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={i}" for i in range(self.parts)])
        return _noted(out, self.path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() and bucketed(); nothing may read them any more, and what was made of them must be
    written."""
    for t in tables:
        if hasattr(t, "stage_table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.stage_table}")
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Canonical proofs of derived rows, by levels.

At rank 0 a derived row is proven by one base fact; at rank r by a base call and a row proven at rank r - 1. Among the
candidates of a row's first rank the least (inputs, rule) wins, so the forest is one and the same for any input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.ids import derived_fact_id
from factloom.functions.lattice import MAY, weaken
from factloom.plans.stage import Rounds, materialize

#: Rules of a relation: direct and through a call.
RULES = {"ReachableCall": ("reachable.direct.v1", "reachable.transitive.v1"), "MayWrite": ("may_write.direct.v1", "may_write.transitive.v1")}
KEY = ["source", "target", "epistemic"]


def proofs(calls: DataFrame, direct: DataFrame, relation: str, max_rank: int = 100_000) -> DataFrame:
    """source, target, epistemic, rank, rule, inputs and tuple_id of every state of every row of the closure.

    calls and direct have fact_id, source, target and epistemic; direct is calls itself for ReachableCall.
    """
    one, more = RULES[relation]
    named = lambda df: df.withColumn("tuple_id", derived_fact_id(F.lit(relation), F.array(F.col("source").cast("string"), F.col("target").cast("string")), F.col("epistemic"), F.col("rule"), F.col("inputs")))
    first = direct.groupBy(*KEY).agg(F.min(F.struct(F.array("fact_id").alias("inputs"), F.lit(one).alias("rule"))).alias("best"))
    done = Rounds(calls.sparkSession, "proofs")
    fresh = done.add(named(first.select(*KEY, F.lit(0).alias("rank"), "best.rule", "best.inputs")))
    step = calls.select(F.col("source").alias("from"), F.col("target").alias("via"), F.col("epistemic").alias("e"), "fact_id")
    for rank in range(1, max_rank + 1):
        sub = fresh.select(F.col("source").alias("s"), "target", "epistemic", "tuple_id")
        found = step.join(sub, step.via == sub.s).select(F.col("from").alias("source"), "target", weaken(F.col("e"), F.col("epistemic")).alias("epistemic"), F.array_sort(F.array("fact_id", "tuple_id")).alias("inputs"))
        best = found.join(done.all().select(*KEY), KEY, "left_anti").groupBy(*KEY).agg(F.min(F.struct("inputs", F.lit(more).alias("rule"))).alias("best"))
        fresh = done.add(named(best.select(*KEY, F.lit(rank).alias("rank"), "best.rule", "best.inputs")))
        if fresh.isEmpty():
            return done.all()
    raise RuntimeError(f"proofs are not complete after {max_rank} ranks")


def final_rows(proven: DataFrame) -> DataFrame:
    """The weakest state of each row, with its proof."""
    weakest = proven.groupBy("source", "target").agg(F.max("epistemic").alias("epistemic"))
    return proven.join(weakest, KEY, "left_semi")


def explain(proven: DataFrame, targets: DataFrame, max_facts: int | None = None) -> tuple[DataFrame, bool]:
    """The proofs that targets (tuple_id) rest on, themselves included, and whether max_facts cut them."""
    seen = materialize(proven.join(targets.select("tuple_id").distinct(), "tuple_id", "left_semi"), "explained")
    front = seen
    while True:
        need = front.select(F.explode("inputs").alias("tuple_id")).distinct()
        front = materialize(proven.join(need, "tuple_id", "left_semi").join(seen.select("tuple_id"), "tuple_id", "left_anti"), "explained-new")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "explained")
        if max_facts is not None and seen.count() > max_facts:
            return seen.orderBy("rank", "tuple_id").limit(max_facts), True
    return seen, False


def missing_inputs(rows: DataFrame, base: DataFrame) -> DataFrame:
    """tuple_id and input of proofs that rest on a fact that is neither there nor a base fact."""
    known = rows.select("tuple_id").union(base.select("fact_id")).distinct().withColumnRenamed("tuple_id", "input")
    return rows.select("tuple_id", F.explode("inputs").alias("input")).join(known, "input", "left_anti")


def unproven(claimed: DataFrame, proven: DataFrame) -> DataFrame:
    """Claimed rows (source, target, epistemic) without an acyclic proof."""
    return claimed.join(proven.select(*KEY), KEY, "left_anti")


def require_proven(claimed: DataFrame, proven: DataFrame) -> DataFrame:
    """claimed, or an error that names a row without an acyclic proof."""
    row = unproven(claimed, proven).orderBy(*KEY).first()
    if row is not None:
        raise ValueError(f"no acyclic provenance proof of {row['source']} > {row['target']} ({row['epistemic']})")
    return claimed


def witnesses(proven: DataFrame) -> DataFrame:
    """result, rule, input and ordinal (from 0): a row for each input of each proof."""
    return proven.select(F.col("tuple_id").alias("result"), "rule", F.posexplode("inputs").alias("ordinal", "input"))


def approximated(proven: DataFrame, relation: str) -> DataFrame:
    """All rows weakened to MAY, with the ids that follow: source, target, epistemic, rule, inputs, tuple_id and was (the id
    before). Inputs that are rows themselves get their new ids, so rows go in the order of their proofs; a cyclic one is an
    error."""
    rows = materialize(proven.select("source", "target", "rule", "inputs", F.col("tuple_id").alias("was")), "approximated-in")
    own = rows.select(F.col("was").alias("input"), F.lit(True).alias("local"))
    uses = materialize(rows.select("was", F.explode("inputs").alias("input")).join(own, "input", "left"), "approximated-uses")
    done, left = Rounds(proven.sparkSession, "approximated"), rows.count()
    renamed = None
    while left:
        now = uses.withColumn("new", F.lit(None).cast("string")) if renamed is None else uses.join(renamed.withColumnRenamed("was", "input"), "input", "left")
        waits = now.groupBy("was").agg(F.count_if(F.expr("local AND new IS NULL")).alias("open"), F.array_sort(F.collect_list(F.coalesce("new", "input"))).alias("inputs"))
        ready = rows.drop("inputs").join(waits.filter("open = 0").drop("open"), "was")
        if renamed is not None:
            ready = ready.join(renamed.select("was"), "was", "left_anti")
        ready = ready.withColumn("epistemic", F.lit(MAY))
        ready = ready.withColumn("tuple_id", derived_fact_id(F.lit(relation), F.array(F.col("source").cast("string"), F.col("target").cast("string")), F.col("epistemic"), F.col("rule"), F.col("inputs")))
        n = done.add(ready.select("source", "target", "epistemic", "rule", "inputs", "tuple_id", "was")).count()
        if not n:
            raise ValueError("the provenance of approximated facts has a cyclic proof")
        left, renamed = left - n, done.all().select("was", F.col("tuple_id").alias("new"))
    return done.all() if renamed is not None else rows.withColumns({"epistemic": F.lit(MAY), "tuple_id": F.col("was")})

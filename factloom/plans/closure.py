"""Transitive closures with the lattice: a semi-naive loop of DataFrame plans.

Each round joins the edges with the rows that the last round added or weakened, keeps the weakest state for each key and
looks up what is new by an outer join. Every round's rows are written once, as a further part of the closure, which cuts
the lineage. Rows enter the frontier at most twice (as MUST and as MAY), so cycles end, and no round rewrites what others
have found. A broadcast is left to the planner, which takes one only where the measured size of
the written side allows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.lattice import MAY, merged, weaken
from factloom.plans.stage import Rounds, discard, materialize

CONVERGED, APPROXIMATED = 0, 1


@dataclass
class Closure:
    """facts (source, target, epistemic); whether they are all there; rounds run."""

    facts: DataFrame
    status: int
    rounds: int


def close(edges: DataFrame, seed: DataFrame, max_rounds: int = 10_000) -> Closure:
    """edges (src, dst, epistemic) and seed (source, target, epistemic): source reaches target through edges, then seed.

    If max_rounds end the loop early, every fact is weakened to MAY and the status says so.
    """
    edges = materialize(merged(edges.select("src", "dst", "epistemic"), ["src", "dst"]).withColumnRenamed("epistemic", "step"), "edges")
    found = Rounds(seed.sparkSession, "closure")
    fresh, rounds = found.add(merged(seed.select("source", "target", "epistemic"), ["source", "target"])), 0
    while True:
        total = merged(found.all(), ["source", "target"])
        if rounds >= max_rounds:
            return Closure(total.withColumn("epistemic", F.lit(MAY)), APPROXIMATED, rounds)
        reached = edges.join(fresh, edges.dst == fresh.source).select(F.col("src").alias("source"), "target", weaken(F.col("step"), F.col("epistemic")).alias("epistemic"))
        known = total.withColumnRenamed("epistemic", "known")
        better = merged(reached, ["source", "target"]).join(known, ["source", "target"], "left").filter("known IS NULL OR epistemic > known")
        fresh = found.add(better.select("source", "target", "epistemic"))
        rounds += 1
        if fresh.isEmpty():
            discard(edges)
            return Closure(total, CONVERGED, rounds)


def double(pairs: DataFrame, max_rounds: int = 64) -> Closure:
    """The closure of pairs (source, target, epistemic) by path doubling: rounds grow with the logarithm of the depth."""
    total = materialize(merged(pairs, ["source", "target"]), "total")
    for rounds in range(1, max_rounds + 1):
        right = total.select(F.col("source").alias("via"), F.col("target").alias("far"), F.col("epistemic").alias("more"))
        longer = total.join(right, total.target == right.via).select("source", F.col("far").alias("target"), weaken(F.col("epistemic"), F.col("more")).alias("epistemic"))
        new = materialize(merged(total.unionByName(longer), ["source", "target"]), "total")
        if new.agg(F.count("*"), F.sum("epistemic")).first() == total.agg(F.count("*"), F.sum("epistemic")).first():
            discard(total)
            return Closure(new, CONVERGED, rounds)
        discard(total)
        total = new
    return Closure(total.withColumn("epistemic", F.lit(MAY)), APPROXIMATED, max_rounds)


def reachable_from(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node: what the roots (node) reach through edges (src, dst), the roots included. A demand-driven restriction."""
    seen = Rounds(edges.sparkSession, "reached")
    fresh = seen.add(roots.select("node").distinct())
    for _ in range(max_rounds):
        step = edges.join(fresh, edges.src == fresh.node).select(F.col("dst").alias("node")).distinct()
        fresh = seen.add(step.join(seen.all(), "node", "left_anti"))
        if fresh.isEmpty():
            return seen.all()
    raise RuntimeError(f"what the roots reach is not closed after {max_rounds} rounds")


def descend(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """edges from nodes that the roots reach: the base of a demand-driven closure."""
    return edges.join(reachable_from(edges, roots, max_rounds).withColumnRenamed("node", "src"), "src", "left_semi")

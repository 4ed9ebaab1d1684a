"""The property graph of all line items: its validator and its projection id move no text of a node or an edge."""

import re

from pyspark.sql import functions as F

from factloom import catalog
from factloom.operators import facts, summary
from factloom.plans import stage
from test_whole import _dealt_by

SF = "/root/testdata/sf0.001"


def _written(monkeypatch):
    """Names and columns of all tables written from now on."""
    found, write, buckets = [], stage.materialize, stage.bucketed
    for module in (stage, catalog):
        monkeypatch.setattr(module, "materialize", lambda df, name: found.append((name, set(df.columns))) or write(df, name))
        monkeypatch.setattr(module, "bucketed", lambda df, key, name: found.append((name, set(df.columns))) or buckets(df, key, name), raising=False)
    return found


def test_projection_id_adds_up_rows_where_they_lie(spark, monkeypatch):
    written = _written(monkeypatch)
    made = catalog.QUERIES["graph_projection_id"](spark, SF)
    assert not any(columns & {"node_id", "edge_id"} for _, columns in written)
    assert {c for c in _dealt_by(made) if not c.isdigit()} <= {"k", "p", "node_id", "label"}  # of 512 sums, and the one unknown node
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_count(1), partial_sum" in plan
    nodes, edges = catalog._graph(spark, SF)
    one = made.first()[0]
    assert one == summary.projection_id(nodes.repartition(7), edges.repartition(5)).first()[0]
    assert one != summary.projection_id(nodes, edges.limit(edges.count() - 1)).first()[0]
    least = edges.agg(F.min("edge_id")).first()[0]
    label = F.when(F.col("edge_id") == least, F.lit("x")).otherwise(F.col("dst")).alias("dst")
    assert one != summary.projection_id(nodes, edges.withColumn("dst", label)).first()[0]


def test_projection_id_counts_equal_rows(spark):
    nodes = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "node_id string, kind int, label string")
    edges = spark.createDataFrame([], "edge_id string, kind int, src string, dst string, alias_state int, support array<string>")
    one, two, three = (summary.projection_id(n, edges).first()[0] for n in (nodes, nodes.union(nodes), nodes.union(nodes).union(nodes)))
    assert len({one, two, three}) == 3


def test_the_graph_is_validated_by_short_keys(spark, monkeypatch):
    written = _written(monkeypatch)
    assert [tuple(r) for r in catalog.QUERIES["property_graph_violations_whole"](spark, SF).collect()] == [("none", 0)]
    assert written and not any(columns & {"node_id", "edge_id", "src", "dst"} for name, columns in written)


def test_ends_of_the_graph_are_looked_up_where_their_function_lies(spark, monkeypatch):
    plans, write = {}, stage.materialize
    monkeypatch.setattr(stage, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    catalog.QUERIES["property_graph_violations_whole"](spark, SF)
    dealt = re.findall(r"Exchange hashpartitioning\(home#\d+L, h#\d+L, \d+\)", plans["lost-ends"])
    assert len(dealt) == 1  # the ends of other functions, to make them distinct


def test_planted_faults_of_a_graph_by_short_keys(spark):
    nodes, edges = (df.localCheckpoint() for df in catalog._graph(spark, SF, kept=True))
    assert facts.graph_violations(nodes, edges).isEmpty()
    gone = nodes.filter("home IS NOT NULL AND kind = 4").orderBy("node_id").first()["node_id"]
    called = edges.filter("kind IN (2, 3) AND dst_home IS NOT NULL AND dst_home != home").orderBy("edge_id").first()["dst"]
    left = nodes.filter(~F.col("node_id").isin(gone, called)).filter("home IS NOT NULL")  # no unknown node either
    ids = [r["edge_id"] for r in edges.filter(F.col("kind") == 6).orderBy("edge_id").limit(3).collect()]
    changed = edges.withColumn("alias_state", F.when(F.col("edge_id") == ids[0], 1).otherwise(F.col("alias_state")))
    changed = changed.withColumn("edge_id", F.when(F.col("edge_id") == ids[1], F.lit(ids[2])).otherwise(F.col("edge_id")))
    twice = left.filter("kind = 1").orderBy("node_id").limit(1).withColumn("label", F.lit("other"))
    left = left.union(twice)
    got = {tuple(r) for r in facts.graph_violations(left, changed).collect()}
    want = {tuple(r) for r in facts.graph_violations(left.drop("home"), changed.drop("home", "dst_home")).collect()}
    assert got == want
    assert {r for r, _ in got} == {"no source", "no target", "alias state", "edge collision", "node collision"}


def test_graph_rows_deal_lines_once_and_hash_no_support_for_a_filter(spark, monkeypatch):
    written = _written(monkeypatch)
    made = catalog.QUERIES["property_graph_rows"](spark, SF)
    assert [name for name, _ in written] == ["graph-calls", "calls", "lines"]
    assert not any(columns & {"ord", "pos", "reason"} for _, columns in written)
    assert not _dealt_by(made)  # all parts of the graph read the buckets
    assert "size(array(" not in made._jdf.queryExecution().executedPlan().toString()


def test_support_positions_leave_out_edges_without_support(spark):
    edges = spark.createDataFrame([("a", ["s", None]), ("b", []), ("c", None)], "edge_id string, support array<string>")
    assert sorted(tuple(r) for r in summary.support_positions(edges).collect()) == [("a", 0, "s"), ("a", 1, None)]

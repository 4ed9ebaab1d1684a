"""Queries over all line items move short keys only: no finished id, and no row that holds one, is dealt out by a shuffle."""

import re

from factloom import catalog
from factloom.operators import facts

SF = "/root/testdata/sf0.001"


def _dealt_by(df):
    """Columns that the plan's shuffles deal by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {c for keys in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan) for c in re.findall(r"(\w+)#", keys)}


def test_base_facts_are_made_after_the_shuffle(spark):
    assert _dealt_by(catalog.QUERIES["base_facts_whole"](spark, SF)) <= {"ord", "fn"}


def test_call_edges_are_counted_by_short_keys(spark):
    assert _dealt_by(catalog.QUERIES["call_traversal_edges"](spark, SF)) <= {"fn", "kind"}


def test_graph_rows_are_made_after_the_shuffle(spark):
    assert _dealt_by(catalog.QUERIES["property_graph_rows"](spark, SF)) <= {"fn"}


def test_typed_facts_are_made_after_the_shuffle(spark):
    assert _dealt_by(catalog.QUERIES["typed_facts_of_summaries"](spark, SF)) <= {"fn", "sup", "line", "epistemic", "callee"}


def test_typed_facts_of_facts_are_made_after_the_shuffle(spark):
    assert _dealt_by(catalog.QUERIES["typed_facts_of_facts"](spark, SF)) <= {"fn", "sup", "line", "epistemic"}


def test_ids_of_several_contents_are_found_by_short_keys(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 1), ("c", "x", 1), ("d", "x", 1), ("d", None, 1)]
    df = spark.createDataFrame(rows, "id string, label string, kind int")
    found = facts.colliding(df, "id", ["label", "kind"])
    assert {r["id"] for r in found.collect()} == {"b", "d"}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_null_and_empty_columns_of_facts(spark):
    cells = {"1": ["f", ""], "2": ["f", None], "3": ["f\t", "m"], "4": None, "5": ["f", "m"]}
    df = spark.createDataFrame([(f"fact:sha256:{k * 64}", "DirectWrite", v, 1, "", []) for k, v in cells.items()], "tuple_id string, relation string, columns array<string>, epistemic int, rule_id string, input_tuple_ids array<string>")
    got = {(r["rule"], r["tuple_id"][-1]) for r in facts.fact_violations(df).collect()}
    assert {("empty column", "1"), ("empty column", "2"), ("control character", "3")} <= got
    assert not {x for x in got if x[1] == "5" or x in {("empty column", "4"), ("control character", "4")}}

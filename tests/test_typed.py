import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import catalog, catalog_typed  # noqa: F401
from factloom.functions import ids
from factloom.operators import graph, proof, summary, typed
from factloom.plans import closure
from factloom.sources import compile_db, store
from factloom.streaming import worklist

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == "factloom.catalog_typed" and n in catalog.ORACLES]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "part", "supplier", "customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_typed_ids_of_all_cell_kinds(spark):
    def fact_id(name, cells):
        field = lambda t: len(t).to_bytes(8, "big") + t
        raw = field(b"relations.v2") + field(name.encode())
        for tag, x in cells:
            raw += bytes([tag]) + (field(x.encode()) if tag in (0, 3) else (x % 2**64).to_bytes(8, "big") if tag in (1, 2) else bytes([x]))
        return "fact:sha256:" + hashlib.sha256(raw).hexdigest()

    f, m = "funcvar:sha256:" + "a" * 64, "memref:sha256:" + "b" * 64
    rows = spark.createDataFrame([("DirectRead", [f, m, "0", "-7", str(2**64 - 1), "5"]), ("UnsupportedFeature", ["", "x\0y", "é"])], "relation string, cells array<string>")
    assert typed.violations(rows).isEmpty()
    got = {r["relation"]: r["fact_id"] for r in typed.with_fact_ids(rows).collect()}
    assert got["DirectRead"] == fact_id("DirectRead", [(0, f), (0, m), (6, 0), (1, -7), (2, 2**64 - 1), (7, 5)])
    raw = b"".join(len(t).to_bytes(8, "big") + t for t in (b"relations.v2", b"UnsupportedFeature"))
    raw += b"".join(b"\3" + len(t).to_bytes(8, "big") + t for t in (b"", b"x\0y", "é".encode()))
    assert got["UnsupportedFeature"] == "fact:sha256:" + hashlib.sha256(raw).hexdigest()


def test_untyped_facts_that_no_relation_takes(spark):
    f = "funcvar:sha256:" + "a" * 64
    rows = [("t1", "LocalFlow", ["a", "b", f], 3), ("t2", "GlobalFlow", ["a", "b"], 1), ("t3", "DirectCall", [f, f], 0), ("t4", "MayWrite", [f, "m"], 2)]
    got = typed.from_facts(spark.createDataFrame(rows, "tuple_id string, relation string, columns array<string>, epistemic int")).collect()
    assert [(r["relation"], r["cells"][-1]) for r in got] == [("UnsupportedFeature", "MUST_NOT"), ("UnsupportedFeature", "MUST"), ("DirectCall", "5"), ("MayWrite", "1")]
    bad = spark.createDataFrame([("t", "MayWrite", ["no id", "m"], 1)], "tuple_id string, relation string, columns array<string>, epistemic int")
    with pytest.raises(Exception, match="no function variant id"):
        typed.from_facts(bad).collect()


def test_digests_tell_meaning_from_evidence(spark):
    functions = spark.createDataFrame([("f",)], "function string")
    item = lambda fields, ref: spark.createDataFrame([("f", 1, fields, ref)], "function string, component int, fields array<string>, provenance string")
    one, two, three = (summary.digests(functions, i) for i in (item(["a", "b"], "p"), item(["a", "b"], "q"), item(["ab", ""], "p")))
    assert one.count() == 14
    first = lambda d: d.filter("component = 1").first()
    assert first(one)["semantic_hash"] == first(two)["semantic_hash"] == hashlib.sha256(b"a\0b\0").hexdigest()
    assert first(one)["evidence_hash"] != first(two)["evidence_hash"] and first(one)["semantic_hash"] != first(three)["semantic_hash"]
    changes = summary.changed(one, two)
    assert [tuple(r) for r in changes.collect()] == [("f", 1, "changed", True)]
    assert summary.has_changed(changes, 1) and not summary.has_changed(changes, 2)


def test_kinds_without_results_say_so(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    none = spark.createDataFrame([], "source string, target string, epistemic int")
    assert summary.scc_results(none, members, 7, F.lit(""), 1).first()["status"] == "unsupported_component"
    assert summary.scc_results(none, members, 2, F.lit(""), 1).first()["facts"] == 0


def test_projection_id_does_not_depend_on_the_order(spark):
    nodes = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "node_id string, kind int, label string")
    edges = spark.createDataFrame([("e", 2, "a", "b", None, ["s", "t"])], "edge_id string, kind int, src string, dst string, alias_state int, support array<string>")
    one = summary.projection_id(nodes, edges).first()[0]
    assert one == summary.projection_id(nodes.orderBy(F.desc("node_id")).repartition(3), edges).first()[0]
    assert one != summary.projection_id(nodes, edges.withColumn("kind", F.lit(3))).first()[0]
    assert [tuple(r) for r in summary.support_positions(edges).collect()] == [("e", 0, "s"), ("e", 1, "t")]


def test_digests_in_hex_and_bytes(spark):
    row = spark.range(1).select(ids.digest_text(ids.digest_bytes(F.lit("AB" * 32))).alias("a"), ids.digest_bytes(F.lit("xy")).alias("b"), ids.sorted_joined(F.array(F.lit("b"), F.lit("a"), F.lit("b")), ",").alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("ab" * 32, None, "a,b")


def test_rows_without_a_proof_raise(spark):
    rows = spark.createDataFrame([("a", "b", 1)], "source string, target string, epistemic int")
    assert proof.require_proven(rows, rows).count() == 1
    with pytest.raises(ValueError, match="no acyclic provenance proof"):
        proof.require_proven(rows, rows.limit(0))


def test_least_proofs_equal_brute_force(spark):
    calls = [("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "a", 1), ("c", "d", 2)]
    c = spark.createDataFrame([(f"fact:{s}{t}", s, t, e) for s, t, e in calls], "fact_id string, source string, target string, epistemic int")
    field = lambda t: f"{len(t.encode())}:{t}"

    def tuple_id(s, t, e, rule, inputs):
        head = "".join(map(field, ["factloom.fact.derived.v1", "ReachableCall", s, t, str(e), rule, *sorted(inputs)]))
        return "fact:sha256:" + hashlib.sha256(head.encode()).hexdigest()

    done = {(s, t, e): (0, "reachable.direct.v1", [f"fact:{s}{t}"]) for s, t, e in calls}
    front, rank = set(done), 0
    while front:
        rank, new = rank + 1, {}
        for s, t, e in calls:
            for k in front:
                key = (s, k[1], max(e, k[2]))
                if t == k[0] and key not in done:
                    new.setdefault(key, []).append(sorted([f"fact:{s}{t}", tuple_id(*k, *done[k][1:])]))
        done |= {k: (rank, "reachable.transitive.v1", min(v)) for k, v in new.items()}
        front = set(new)
    got = {(r["source"], r["target"], r["epistemic"]): (r["rank"], r["rule"], r["inputs"], r["tuple_id"]) for r in proof.proofs(c, c, "ReachableCall").collect()}
    assert got == {k: (*v, tuple_id(*k, *v[1:])) for k, v in done.items()}


def test_stream_of_two_batches_a_replay_and_a_pop(spark, tmp_path):
    schema = "kind string, target string, seq long, delta_id string, priority int, attempts int"
    feed, snaps = tmp_path / "feed", store.Snapshots(spark, str(tmp_path / "s"))

    def stream(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        worklist.run(spark.readStream.schema(schema).parquet(str(feed)), snaps, str(tmp_path / checkpoint)).awaitTermination()

    stream([("k", "a", 1, "d1", 5, 0), ("k", "b", 2, "d2", 3, 0)], "c")
    stream([("k", "a", 3, "d3", 1, 2)], "c")
    assert [(r["target"], r["delta_ids"], r["priority"]) for r in worklist.pop(snaps)] == [("a", ["d1", "d3"], 1)]
    stream([("k", "c", 4, "d4", 9, 0)], "replayed from the start")
    assert sorted((r["target"], r["delta_ids"]) for r in worklist.pending(snaps).collect()) == [("b", ["d2"]), ("c", ["d4"])]
    assert [r["target"] for r in worklist.pop(snaps, 5)] == ["b", "c"] and worklist.pop(snaps) == []


def test_commands_with_quotes_and_flags_that_end_like_the_source(spark):
    row = spark.range(1).select(compile_db.split_command(F.lit("cc -DX=\"a b\" '-DY=/a/b.c' -c b.c")).alias("w")).select("w", compile_db.replay_flags(F.col("w"), F.lit("b.c")).alias("flags")).first()
    assert row["w"] == ["cc", "-DX=a b", "-DY=/a/b.c", "-c", "b.c"] and row["flags"] == ["-DX=a b", "-DY=/a/b.c"]


def test_snapshots_whose_summaries_differ_are_refused(spark, tmp_path):
    snaps = store.Snapshots(spark, str(tmp_path))
    one = spark.createDataFrame([("s",)], "summary_id string")
    with pytest.raises(ValueError):
        store.publish_checked(snaps, one, one.limit(0), {"g": one})
    store.publish_checked(snaps, one, one, {"g": one})
    assert snaps.read("g").count() == 1


def test_relations_round_trip_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("t2", "R", ["a", "b"], 1), ("t1", "R", ["c", "d"], 2)], "tuple_id string, relation string, columns array<string>, epistemic int")
    store.write_relations(rows, str(tmp_path))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/R").collect()] == ["c\td\t2", "a\tb\t1"]
    assert {tuple(r) for r in store.read_relation(spark, f"{tmp_path}/R").collect()} == {("a", "b", 1), ("c", "d", 2)}


def test_search_that_is_cut_raises(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert closure.reachable_from(e, roots).count() == 6
    with pytest.raises(RuntimeError):
        closure.reachable_from(e, roots, max_rounds=2)
    assert graph.strongly_connected(e.union(spark.createDataFrame([(3, 1)], "src long, dst long"))).filter("size = 3").count() == 3

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import catalog, catalog_programs, cli
from factloom.functions import ids
from factloom.operators import instructions, proof
from factloom.sources import compile_db, store

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if getattr(f, "__module__", "") == catalog_programs.__name__]


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.ORACLES])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_approximated_proofs_and_witnesses(spark):
    p = catalog.QUERIES["proof_explanations"](spark, SF)
    rows, got = {r["tuple_id"]: r for r in p.collect()}, proof.approximated(p, "ReachableCall").collect()
    new = {r["was"]: r["tuple_id"] for r in got}
    assert len(got) == len(rows) == len(new)
    for r in got:
        assert r["epistemic"] == 2 and r["inputs"] == sorted(new.get(i, i) for i in rows[r["was"]]["inputs"])
    again = proof.approximated(p, "ReachableCall").select("tuple_id", ids.derived_fact_id(F.lit("ReachableCall"), F.array(F.col("source").cast("string"), F.col("target").cast("string")), F.lit(2), F.col("rule"), F.col("inputs")).alias("id"))
    assert again.filter("id <> tuple_id").isEmpty()
    assert proof.witnesses(p).count() == sum(len(r["inputs"]) for r in rows.values())


def test_cyclic_proofs_cannot_be_approximated(spark):
    rows = [("a", "b", 1, "r", ["y"], "x"), ("b", "a", 1, "r", ["x"], "y"), ("c", "d", 1, "r", ["base"], "z")]
    p = spark.createDataFrame(rows, "source string, target string, epistemic int, rule string, inputs array<string>, tuple_id string")
    with pytest.raises(ValueError, match="cyclic"):
        proof.approximated(p, "ReachableCall")
    assert proof.approximated(p.filter("tuple_id = 'z'"), "ReachableCall").count() == 1
    assert proof.approximated(p.limit(0), "ReachableCall").isEmpty()


def test_instructions_with_nulls(spark):
    rows = [("f", 1, "load", "x", None, [], False), ("f", 2, None, None, None, None, None), ("f", 3, "call", "y", None, [("a", "argument")], True), ("f", 4, "ret", None, None, [("y", "instruction")], None)]
    i = spark.createDataFrame(rows, "function string, pos int, opcode string, result string, pointer string, operands array<struct<name: string, kind: string>>, inline_asm boolean")
    assert {tuple(r) for r in instructions.memory_accesses(i).collect()} == {("f", 1, "<unknown>", "READ"), ("f", 3, "<call-effect>", "UNKNOWN")}
    assert {tuple(r) for r in instructions.value_flows(i).collect()} == {("f", "a", "y", "call"), ("f", "y", "<return>", "ret")}
    assert instructions.unsupported(i).count() == 1


def test_words_of_a_pointer_analysis(spark):
    rows = spark.createDataFrame([("MUST_CALL", "READ"), ("UNKNOWN_CALL", "x"), ("MAY_CALL", None)], "c string, e string")
    assert [tuple(r) for r in rows.select(instructions.call_epistemic(F.col("c")), instructions.effect_kind(F.col("e"))).collect()] == [(1, "READ"), (6, "UNKNOWN"), (2, "UNKNOWN")]


def test_projects(tmp_path):
    with pytest.raises(ValueError, match="empty"):
        compile_db.resolve_project("")
    with pytest.raises(ValueError, match="no directory"):
        compile_db.resolve_project(str(tmp_path / "none"))
    database = tmp_path / "compile_commands.json"
    for text in (None, ""):
        if text is not None:
            database.write_text(text)
        with pytest.raises(ValueError, match="missing or empty"):
            compile_db.resolve_project(str(tmp_path))
    database.write_text("[]")
    assert compile_db.resolve_project(str(tmp_path))["output"].endswith("/.factloom")
    assert compile_db.resolve_project(str(tmp_path), "/x/../y")["output"] == "/y"


def test_parameters_and_text(spark):
    assert [tuple(r) for r in store.query_text(spark, "SELECT id, id > :least AS more FROM range(2)", least=0).collect()] == [("0", "false"), ("1", "true")]


def test_replayed_batches(spark):
    made = lambda rows: spark.createDataFrame(rows, "run string, batch int, fact_id string")
    have = made([("r", 1, "a"), ("r", 1, "b")])
    new, clash = store.append_batches(have, made([("r", 1, "b"), ("r", 1, "a"), ("r", 1, "a"), ("r", 2, "c"), ("r", 2, "c")]))
    assert [tuple(r) for r in new.collect()] == [("r", 2, "c")] and clash.isEmpty()
    assert store.append_batches(have, made([("r", 1, "a")]))[1].count() == 1


def test_command_line(spark, tmp_path, capsys):
    held = store.Snapshots(spark, str(tmp_path))
    nodes = spark.createDataFrame([("a", "main"), ("b", "read"), ("c", "copy")], "node string, label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    digest = lambda d: spark.createDataFrame([("a", 1, d, d, 1)], "function string, component int, semantic_hash string, evidence_hash string, item_count int")
    old = held.publish({"nodes": nodes, "edges": edges, "digests": digest("x")})
    new = held.publish({"nodes": nodes, "edges": edges, "digests": digest("y")})
    root = ["--root", str(tmp_path)]
    assert cli.main(["callees", *root, "a"]) == 0 and capsys.readouterr().out == "b read\n"
    assert list(cli.answers(spark, ["flow", *root, "a", "c"])) == ["a", "b", "c"]
    assert list(cli.answers(spark, ["flow", *root, "--max-depth", "1", "a", "c"]))[-1] == "truncated: MAX_DEPTH"
    assert len(list(cli.answers(spark, ["diff", *root, old, new]))) == 1
    assert cli.main(["callees", "--root", str(tmp_path / "none"), "a"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["flow", *root, "--max-depth", "-1", "a", "c"])

"""Queries of instructions, pointer facts, coverage, results of successors, batches and stores; with their SQL. All line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import CALLS, REACH, _all_rows, _proofs, query
from factloom.operators import graph, instructions, proof, summary
from factloom.plans import closure, workload
from factloom.plans.stage import materialize, read_table
from factloom.sources import store

OPCODES = ["load", "store", "atomicrmw", "cmpxchg", "call", "invoke", "phi", "ret", "add", "callbr"]
_SQL = f"""i AS (SELECT l_partkey AS function, l_orderkey * 8 + l_linenumber AS pos, {OPCODES}[l_suppkey % 10 + 1] AS opcode,
  CASE WHEN l_suppkey % 10 NOT IN (1, 7) THEN 'v' || l_linenumber END AS result, 'mem:' || l_suppkey AS pointer, 'v' || (l_linenumber - 1) AS first, 'c' || l_orderkey % 100 AS second, l_returnflag = 'R' AS inline_asm FROM lineitem)"""


def _instructions(spark, sf_dir):
    """Line items as instructions, with an instruction and a constant as operands."""
    op = F.element_at(F.array(*[F.lit(x) for x in OPCODES]), (F.col("l_suppkey") % 10 + 1).cast("int"))
    operand = lambda prefix, value, kind: F.struct(F.concat(F.lit(prefix), value.cast("string")).alias("name"), F.lit(kind).alias("kind"))
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("function"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), op.alias("opcode"),
        F.when(~(F.col("l_suppkey") % 10).isin(1, 7), F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))).alias("result"),
        F.concat(F.lit("mem:"), F.col("l_suppkey").cast("string")).alias("pointer"),
        F.array(operand("v", F.col("l_linenumber") - 1, "instruction"), operand("c", F.col("l_orderkey") % 100, "constant")).alias("operands"),
        (F.col("l_returnflag") == "R").alias("inline_asm"),
    )


@query(f"""WITH {_SQL} SELECT function, pos, CASE WHEN opcode IN ('call', 'invoke') THEN '<call-effect>' ELSE pointer END AS location,
  CASE opcode WHEN 'load' THEN 'READ' WHEN 'store' THEN 'WRITE' ELSE 'UNKNOWN' END AS effect FROM i WHERE opcode NOT IN ('phi', 'ret', 'add', 'callbr')""")
def memory_accesses(spark, sf_dir):
    return instructions.memory_accesses(_instructions(spark, sf_dir))


@query(f"""WITH {_SQL} SELECT function, first AS source, result AS sink, opcode FROM i WHERE result IS NOT NULL UNION SELECT function, second, result, opcode FROM i WHERE opcode = 'phi'
UNION SELECT function, first, '<return>', opcode FROM i WHERE opcode = 'ret' UNION SELECT function, second, '<return>', opcode FROM i WHERE opcode = 'ret'""")
def instruction_flows(spark, sf_dir):
    return instructions.value_flows(_instructions(spark, sf_dir))


@query(f"""WITH {_SQL} SELECT 'unsupported_construct' AS kind, 'inline assembly / callbr' AS reason, function AS scope FROM i WHERE opcode = 'callbr' OR (opcode IN ('call', 'invoke') AND inline_asm)""")
def unsupported_constructs(spark, sf_dir):
    return instructions.unsupported(_instructions(spark, sf_dir))


_EDGES = """e AS (SELECT l_partkey AS function, CASE WHEN l_suppkey % 7 > 0 THEN 's' || l_suppkey END AS source, CASE WHEN l_orderkey % 11 > 0 THEN 'd' || l_linenumber END AS sink,
  l_returnflag = 'A' AS pointers, ['MustAlias', 'NoAlias', 'MayAlias', 'PartialAlias', 'other'][l_linenumber % 5 + 1] AS alias FROM lineitem)"""
_ORIGIN = "analyzer=run-1;config=pointer_analysis=andersen_wave_diff\nsoft_analysis_budget_seconds=60\nmax_graph_nodes=1000\nmax_emitted_facts=5000\nfield_sensitive=true\n"


def _pointer_edges(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in ("MustAlias", "NoAlias", "MayAlias", "PartialAlias", "other")])
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("function"), F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("source"),
        F.when(F.col("l_orderkey") % 11 > 0, F.concat(F.lit("d"), F.col("l_linenumber").cast("string"))).alias("sink"),
        (F.col("l_returnflag") == "A").alias("pointers"), F.element_at(words, F.col("l_linenumber") % 5 + 1).alias("alias"),
    )


@query(f"""WITH {_EDGES}, w AS (SELECT * FROM e WHERE source IS NOT NULL AND sink IS NOT NULL)
SELECT *, '{_ORIGIN}' AS provenance FROM (SELECT 'value_flow' AS kind, source AS left, sink AS right, 1::INT AS state FROM w
UNION SELECT 'alias', source, sink, CASE alias WHEN 'MustAlias' THEN 1 WHEN 'NoAlias' THEN 3 WHEN 'other' THEN 6 ELSE 2 END FROM w WHERE pointers
UNION SELECT 'unknown', 'value_flow_edge', 'unmapped_node', 6 FROM e WHERE source IS NULL OR sink IS NULL)""")
def pointer_facts(spark, sf_dir):
    return instructions.pointer_facts(_pointer_edges(spark, sf_dir), instructions.provenance("run-1", 60, 1000, 5000))


@query(f"""WITH {_EDGES}, n AS (SELECT function, count(*) FILTER (source IS NULL OR sink IS NULL) AS unmapped FROM e GROUP BY 1)
SELECT *, CASE WHEN unmapped > 0 THEN 'complete-with-unknowns' ELSE 'complete' END AS completion FROM n""")
def completion_status(spark, sf_dir):
    return instructions.completion(_pointer_edges(spark, sf_dir), "function")


# --- unknowns in reach, coverage, results of successors: line items of the recursive queries


_UNKNOWN = f"""{CALLS}, u AS (SELECT caller AS source, reason, 2 AS epistemic FROM calls WHERE callee IS NULL
  UNION SELECT e.src, u.reason, 2 FROM edges e JOIN u ON e.dst = u.source)"""


def _unknown_effects(spark, sf_dir):
    sites = workload.call_sites(spark, sf_dir).filter("callee IS NULL")
    seed = sites.select(F.col("caller").alias("source"), F.col("reason").alias("target"), F.lit(2).alias("epistemic"))
    return closure.close(workload.call_edges(spark, sf_dir), seed).facts


@query(f"WITH RECURSIVE {_UNKNOWN} SELECT source, reason, epistemic FROM u")
def unknown_effects(spark, sf_dir):
    """Functions that reach an unresolved call, and its reason."""
    return _unknown_effects(spark, sf_dir).withColumnRenamed("target", "reason")


@query(f"""WITH RECURSIVE {_UNKNOWN} SELECT caller AS function, count(*) AS sites, count(*) FILTER (callee IS NULL) AS unresolved, count(*) FILTER (epistemic <> 1) AS weak,
  caller NOT IN (SELECT source FROM u) AS covered FROM calls GROUP BY 1""")
def soundness_coverage(spark, sf_dir):
    return summary.coverage(workload.call_sites(spark, sf_dir), _unknown_effects(spark, sf_dir))


@query(f"""WITH RECURSIVE {CALLS}, s AS (SELECT src AS source, dst AS target, step AS epistemic FROM edges UNION SELECT DISTINCT l_partkey, -l_suppkey, 2 FROM lineitem WHERE l_quantity >= 46 AND l_tax > 0.07),
r AS (SELECT * FROM s UNION SELECT e.src, r.target, greatest(e.step, r.epistemic) FROM edges e JOIN r ON e.dst = r.source)
SELECT source, target, max(epistemic) AS epistemic FROM r GROUP BY 1, 2""")
def supported_reachable_call(spark, sf_dir):
    """The closure of calls with further support rows, known from elsewhere, as part of its seed."""
    edges = workload.call_edges(spark, sf_dir)
    given = workload.lines(spark, sf_dir).filter("l_tax > 0.07").select(F.col("l_partkey").alias("source"), (-F.col("l_suppkey")).alias("target"), F.lit(2).alias("epistemic"))
    return closure.close(edges, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "epistemic").unionByName(given.distinct())).facts


@query(f"""WITH RECURSIVE {CALLS}, {REACH}, w AS (SELECT source, target, max(epistemic) AS epistemic FROM r GROUP BY 1, 2), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
mutual AS (SELECT a.source AS node, min(a.target) AS low FROM w a JOIN w b ON a.source = b.target AND a.target = b.source GROUP BY 1),
scc AS (SELECT node, least(node, coalesce(low, node)) AS component FROM nodes LEFT JOIN mutual USING (node)),
dag AS (SELECT DISTINCT a.component AS src_scc, b.component AS dst_scc FROM edges JOIN scc a ON src = a.node JOIN scc b ON dst = b.node WHERE a.component <> b.component)
SELECT src_scc AS component, source, target, epistemic FROM w JOIN scc ON source = node JOIN dag ON dst_scc = component""")
def successor_results(spark, sf_dir):
    """For each component, what the functions of its successors reach."""
    edges = workload.call_edges(spark, sf_dir)
    reach = closure.close(edges, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "epistemic")).facts
    members = materialize(graph.strongly_connected(edges), "members")
    return summary.successor_results(reach, members, graph.condensation(edges, members))


@query()
def approximated_proofs(spark, sf_dir):
    """The proofs of all reachable calls, weakened to MAY with new ids; a test holds them against a plain loop."""
    return proof.approximated(_proofs(spark, sf_dir)[1], "ReachableCall")


@query()
def witness_rows(spark, sf_dir):
    return proof.witnesses(_proofs(spark, sf_dir)[1])


# --- stores


@query("""SELECT 'append' AS what, l_orderkey AS run, l_linenumber AS batch, count(DISTINCT l_partkey || '-' || l_suppkey) AS n FROM lineitem WHERE l_returnflag <> 'A' AND (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'A') GROUP BY 2, 3
UNION ALL SELECT 'clash', l_orderkey, l_linenumber, 1 FROM lineitem GROUP BY 2, 3 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A')
  AND list_sort(list_distinct(list(l_partkey || '-' || l_suppkey) FILTER (l_returnflag = 'A'))) <> list_sort(list_distinct(list(l_partkey || '-' || l_suppkey) FILTER (l_returnflag <> 'A')))""")
def fact_batches(spark, sf_dir):
    """Facts that a store takes, by batch, and batches that it has with other facts."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("batch"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("fact_id"), "l_returnflag")
    new, clash = store.append_batches(rows.filter("l_returnflag = 'A'").drop("l_returnflag"), rows.filter("l_returnflag <> 'A'").drop("l_returnflag"))
    count = new.groupBy("run", "batch").agg(F.count("*").alias("n")).select(F.lit("append").alias("what"), "run", "batch", "n")
    return count.unionByName(clash.select(F.lit("clash").alias("what"), "run", "batch", F.lit(1).cast("long").alias("n")))


@query("SELECT l_partkey AS key, p_name AS bytes, p_partkey IS NOT NULL AS found FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def objects_of_store(spark, sf_dir):
    have = read_table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("bytes"))
    return store.objects_of(have, read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")))

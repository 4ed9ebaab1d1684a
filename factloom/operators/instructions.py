"""Local facts of functions from a table of instructions, and facts of a pointer analysis from a table of its edges.

Instructions: function, pos, opcode, result (its name, or null), pointer (the location that it touches, or null), operands
(array of name and kind: instruction, argument, constant) and inline_asm. Rows with a null opcode give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lattice import MAY, MUST, MUST_NOT, UNKNOWN

CALL_EFFECT, RETURN = "<call-effect>", "<return>"

# Effects of opcodes, and the states of the words of a pointer analysis.
EFFECTS = {"load": "READ", "store": "WRITE", "atomicrmw": "UNKNOWN", "cmpxchg": "UNKNOWN", "call": "UNKNOWN", "invoke": "UNKNOWN"}
ALIAS_WORDS = {"MustAlias": "MUST_ALIAS", "NoAlias": "NO_ALIAS", "MayAlias": "MAY_ALIAS", "PartialAlias": "MAY_ALIAS"}
ALIAS_STATES = {"MUST_ALIAS": MUST, "NO_ALIAS": MUST_NOT, "UNKNOWN_ALIAS": UNKNOWN}
CALL_STATES = {"MUST_CALL": MUST, "UNKNOWN_CALL": UNKNOWN}
EFFECT_WORDS = {"READ": "READ", "WRITE": "WRITE"}


def _mapped(words: dict, word: Column, otherwise) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), word), F.lit(otherwise))


def alias_epistemic(word: Column) -> Column:
    """The state of a word such as MUST_ALIAS; MAY for any other."""
    return _mapped(ALIAS_STATES, word, MAY)


def call_epistemic(word: Column) -> Column:
    return _mapped(CALL_STATES, word, MAY)


def effect_kind(word: Column) -> Column:
    return _mapped(EFFECT_WORDS, word, "UNKNOWN")


def memory_accesses(instructions: DataFrame) -> DataFrame:
    """function, pos, location and effect of each instruction that touches memory; calls touch an unknown location."""
    touching = instructions.filter(F.col("opcode").isin(*EFFECTS))
    location = F.when(F.col("opcode").isin("call", "invoke"), CALL_EFFECT).otherwise(F.coalesce("pointer", F.lit("<unknown>")))
    return touching.select("function", "pos", location.alias("location"), _mapped(EFFECTS, F.col("opcode"), "UNKNOWN").alias("effect"))


def value_flows(instructions: DataFrame) -> DataFrame:
    """function, source, sink and opcode, distinct: operands that are instructions or arguments flow into the result, all
    incoming values of a phi into it, and the value of a ret into the function's return."""
    used = instructions.select("function", "opcode", "result", F.explode("operands").alias("o"))
    into = used.filter("result IS NOT NULL AND (opcode = 'phi' OR o.kind IN ('instruction', 'argument'))")
    rows = into.select("function", F.col("o.name").alias("source"), F.col("result").alias("sink"), "opcode")
    back = used.filter("opcode = 'ret'").select("function", F.col("o.name").alias("source"), F.lit(RETURN).alias("sink"), "opcode")
    return rows.unionByName(back).distinct()


def unsupported(instructions: DataFrame) -> DataFrame:
    """kind, reason and scope (the function) of inline assembly and callbr."""
    bad = instructions.filter("opcode = 'callbr' OR (opcode IN ('call', 'invoke') AND inline_asm)")
    return bad.select(F.lit("unsupported_construct").alias("kind"), F.lit("inline assembly / callbr").alias("reason"), F.col("function").alias("scope"))


def provenance(run: str, seconds: int, nodes: int, facts: int, field_sensitive: bool = True) -> Column:
    """The analyzer's run and its canonical configuration, in one text."""
    settings = {"pointer_analysis": "andersen_wave_diff", "soft_analysis_budget_seconds": seconds, "max_graph_nodes": nodes, "max_emitted_facts": facts, "field_sensitive": str(field_sensitive).lower()}
    return F.lit(f"analyzer={run};config=" + "".join(f"{k}={v}\n" for k, v in settings.items()))


def pointer_facts(edges: DataFrame, origin: Column) -> DataFrame:
    """kind (value_flow, alias, unknown), left, right, state and provenance, distinct.

    edges: source and sink (null where no value of the program stands for the node), pointers (both are) and alias, the
    analysis' word for the pair. An edge with an unmapped end is an unknown and nothing else.
    """
    whole = F.col("source").isNotNull() & F.col("sink").isNotNull()
    word = _mapped(ALIAS_WORDS, F.col("alias"), "UNKNOWN_ALIAS")
    row = lambda kind, left, right, state: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), state.cast("int").alias("state"))
    flow = row("value_flow", F.col("source"), F.col("sink"), F.lit(MUST))
    alias = row("alias", F.col("source"), F.col("sink"), alias_epistemic(word))
    lost = row("unknown", F.lit("value_flow_edge"), F.lit("unmapped_node"), F.lit(UNKNOWN))
    made = F.when(~whole, F.array(lost)).when(F.coalesce("pointers", F.lit(False)), F.array(flow, alias)).otherwise(F.array(flow))
    return edges.select(F.explode(made).alias("f")).select("f.*").distinct().withColumn("provenance", origin)


def completion(edges: DataFrame, unit: str) -> DataFrame:
    """unit, its number of unmapped edges, and whether it is complete or complete-with-unknowns."""
    lost = F.count_if(F.col("source").isNull() | F.col("sink").isNull())
    state = F.when(F.col("unmapped") > 0, "complete-with-unknowns").otherwise("complete")
    return edges.groupBy(unit).agg(lost.alias("unmapped")).withColumn("completion", state)

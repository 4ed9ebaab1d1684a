"""Summaries of functions: their components' digests and identities, changes, results by component of the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import ids

# The components of a summary by code, and those that whole-program results exist for.
COMPONENTS = {
    1: "CALLS", 2: "MEMORY_EFFECTS", 3: "VALUE_FLOW", 4: "CONTROL_FLOW", 5: "RANGE_FACTS", 6: "ALIAS_FACTS", 7: "TAINT",
    8: "OWNERSHIP", 9: "LOCKS", 10: "STATE", 11: "UNKNOWNS", 12: "ASSUMPTIONS", 13: "DEPENDENCIES", 14: "PROVENANCE",
}
PROVENANCE = 14
RESULT_RELATION = {1: "ReachableCall", 2: "MayWrite"}
STATUSES = ("converged", "approximated", "unsupported_component")


def component_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv]), code)


def digests(functions: DataFrame, items: DataFrame, key: str = "function") -> DataFrame:
    """key, component, semantic_hash, evidence_hash, item_count and payload_length of all 14 components of each function.

    items: key, component, fields (array of strings) and provenance. The semantic hash is of all fields, each ended by a zero
    byte, of the items in their order; the evidence hash has what they rest on after that. Provenance itself has no meaning,
    only evidence. The items of one component of one function make one row; items of many functions never meet.
    """
    by = items.groupBy(key, "component").agg(F.array_sort(F.collect_list(F.struct("fields", F.coalesce("provenance", F.lit("")).alias("provenance")))).alias("items"))
    ended = F.array_join(F.transform("items", lambda i: F.array_join(F.transform(i["fields"], lambda f: F.concat(f, F.lit("\0"))), "")), "")
    bare = F.array_join(F.transform("items", lambda i: F.array_join(i["fields"], "")), "")
    meaning = F.when(F.col("component") == PROVENANCE, "").otherwise(ended)
    rests_on = F.when(F.col("component") == PROVENANCE, bare).otherwise(F.array_join(F.transform("items", lambda i: i["provenance"]), ""))
    found = by.select(key, "component", meaning.alias("m"), F.concat(meaning, rests_on).alias("e"), F.size("items").alias("n"))
    every = functions.select(key).distinct().select(key, F.explode(F.array(*[F.lit(c) for c in COMPONENTS])).alias("component"))
    text = lambda c: F.coalesce(c, F.lit("")).cast("binary")
    return every.join(found, [key, "component"], "left").select(
        key, "component", F.sha2(text("m"), 256).alias("semantic_hash"), F.sha2(text("e"), 256).alias("evidence_hash"),
        F.coalesce("n", F.lit(0)).alias("item_count"), F.octet_length(text("m")).cast("long").alias("payload_length"),
    )


def summary_ids(component_digests: DataFrame, key: str = "function") -> DataFrame:
    """key and summary_id: the hash of the schema's version, the function and its 14 components' evidence, in their order.
    The time of creation is no part of it."""
    parts = component_digests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "evidence_hash", "item_count"))).alias("c"))
    each = F.transform("c", lambda x: F.concat_ws(":", x["component"].cast("string"), x["evidence_hash"], x["item_count"].cast("string")))
    return parts.select(key, ids.stable_id("summary", F.concat(ids.fields(F.lit("summary.v1"), F.col(key)), ids.field_list(each))).alias("summary_id"))


def changed(old: DataFrame, new: DataFrame, key: str = "function") -> DataFrame:
    """key, component, change and evidence_only of components that differ; a component of no items on one side is added or
    removed."""
    a = old.select(key, "component", F.col("semantic_hash").alias("sa"), F.col("evidence_hash").alias("ea"), F.col("item_count").alias("na"))
    b = new.select(key, "component", F.col("semantic_hash").alias("sb"), F.col("evidence_hash").alias("eb"), F.col("item_count").alias("nb"))
    both = a.join(b, [key, "component"], "full_outer").na.fill(0, ["na", "nb"])
    change = F.when((F.col("na") == 0) & (F.col("nb") > 0), "added").when((F.col("na") > 0) & (F.col("nb") == 0), "removed").when(~F.col("ea").eqNullSafe(F.col("eb")) & (F.col("na") > 0), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(key, "component", "change", F.col("sa").eqNullSafe(F.col("sb")).alias("evidence_only"))


def has_changed(changes: DataFrame, component: int) -> bool:
    return not changes.filter(F.col("component") == component).isEmpty()


def scc_results(facts: DataFrame, members: DataFrame, component: int, tuple_id: Column, rounds: int, approximated: bool = False) -> DataFrame:
    """component (of the call graph), component_kind, status, iteration_count, facts and fixpoint_hash: the results whose source
    lies in a component, a row for every component, with no facts too. Kinds without results have a status that says so."""
    relation = RESULT_RELATION.get(component)
    every = members.select("component").distinct()
    head = [F.lit(component).alias("component_kind")]
    if relation is None:
        return every.select("component", *head, F.lit(STATUSES[2]).alias("status"), F.lit(0).alias("iteration_count"), F.lit(0).cast("long").alias("facts"), F.lit(None).cast("string").alias("fixpoint_hash"))
    own = facts.join(members.withColumnRenamed("node", "source"), "source").select("component", tuple_id.alias("t"))
    # Two levels of hashes: no array holds all facts of a component, whatever its size.
    parts = own.groupBy("component", F.substring("t", -2, 2).alias("p")).agg(F.array_sort(F.collect_list("t")).alias("ts"), F.count("*").alias("n"))
    parts = parts.select("component", "n", F.struct("p", F.sha2(ids.field_list(F.col("ts")), 256).alias("h")).alias("ph"))
    whole = parts.groupBy("component").agg(F.sum("n").alias("facts"), F.array_sort(F.collect_list("ph")).alias("hs"))
    whole = whole.select("component", "facts", F.sha2(ids.field_list(F.transform("hs", lambda x: x["h"])), 256).alias("fixpoint_hash"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    status = STATUSES[1] if approximated else STATUSES[0]
    return every.join(whole, "component", "left").select("component", *head, F.lit(status).alias("status"), F.lit(rounds).alias("iteration_count"), F.coalesce("facts", F.lit(0)).cast("long").alias("facts"), F.coalesce("fixpoint_hash", none).alias("fixpoint_hash"))


def inadmissible(results: DataFrame) -> DataFrame:
    """results (component, component_kind, status, iteration_count, fixpoint_hash, relation) that a store refuses, with rule."""
    relation = F.element_at(F.create_map(*[F.lit(x) for kv in RESULT_RELATION.items() for x in kv]), F.col("component_kind"))
    rule = (
        F.when(relation.isNull(), "component kind")
        .when(~F.coalesce(F.col("status").isin(*STATUSES[:2]), F.lit(False)), "status")
        .when(~F.coalesce(F.col("iteration_count") > 0, F.lit(False)), "iterations")
        .when(~F.coalesce(F.col("fixpoint_hash").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "hash")
        .when(~F.coalesce(F.col("relation") == relation, F.lit(False)), "relation")
    )
    return results.withColumn("rule", rule).filter("rule IS NOT NULL")


def reusable(cached: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of cached whose input hash is still the current one: results that need not be computed again."""
    return cached.join(current.select(*keys, F.col("input_hash").alias("now")), keys).filter(F.col("input_hash") == F.col("now")).drop("now")


def replace_dependencies(current: DataFrame, history: DataFrame, incoming: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(current, history): the rows of the consumers that incoming names are replaced, and every row that comes is appended to
    the history with its epoch, an edge of several kinds once for each."""
    kept = current.join(incoming.select("consumer").distinct(), "consumer", "left_anti")
    now = incoming.select(*current.columns).distinct()
    return kept.unionByName(now), history.unionByName(incoming.withColumn("epoch", F.lit(epoch)).select(*history.columns))


def support_positions(edges: DataFrame, *more: str) -> DataFrame:
    """edge_id, more columns of the edge, position and support of each edge's support, in its order. The outer form with a
    filter after it: of the inner one Spark makes a filter below, which would hash the support of every row once more."""
    return edges.select("edge_id", *more, F.posexplode_outer("support").alias("position", "support")).filter("position IS NOT NULL")


def projection_id(nodes: DataFrame, edges: DataFrame, schema: str = "cpg.v1") -> DataFrame:
    """One row, projection_id: the hash of the whole graph, whatever the order of its rows. Each row's SHA-256 is one of 256
    parts of its table and is added up there, in eight sums of 32 bits of it each; the parts' counts and sums are hashed in
    their order. So no row of the graph is moved, written or sorted. Sums tell graphs apart; they are no seal against somebody
    who picks rows to forge one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = nodes.select(F.lit("n").alias("k"), F.sha2(ids.fields(text("node_id"), text("kind"), text("label")), 256).alias("h"))
    e = edges.select(F.lit("e").alias("k"), F.sha2(F.concat(ids.fields(*[text(c) for c in ("edge_id", "kind", "src", "dst", "alias_state")]), ids.field_list(F.col("support"))), 256).alias("h"))
    words = [F.xxhash64(F.substring("h", 16 * i + 1, 16)) for i in range(4)]  # of 64 bits of the hash each
    halves = [x for w in words for x in (w.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(w, 32))]
    each = n.union(e).select("k", F.substring("h", 1, 2).alias("p"), *[x.alias(f"s{i}") for i, x in enumerate(halves)])
    sums = [f"s{i}" for i in range(len(halves))]
    parts = each.groupBy("k", "p").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    parts = parts.select("k", "p", ids.fields(F.col("k"), F.col("p"), F.col("n"), *[F.col(s) for s in sums]).alias("t"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("k", "p", "t"))).alias("ts"))
    return whole.select(ids.stable_id("cpgproj", F.concat(ids.field(F.lit(schema)), ids.field_list(F.transform("ts", lambda x: x["t"])))).alias("projection_id"))


# Codes of edges that a traversal of calls or of flows follows.
RELEVANT = {"calls": (2, 3), "flows": (6,)}


def relevant(edges: DataFrame, traversal: str) -> DataFrame:
    return edges.filter(F.col("kind").isin(*RELEVANT[traversal]))


def manifest_ids(units: DataFrame) -> DataFrame:
    """build and manifest_id of translation units (build, path, arguments): each unit's fields, sorted by path and arguments."""
    unit = ids.fields(F.col("path"), F.array_join("arguments", "\0"))
    by = units.groupBy("build").agg(F.array_sort(F.collect_list(F.struct("path", F.array_join("arguments", "\0").alias("a"), unit.alias("u")))).alias("us"), F.count("*").alias("n"))
    return by.select("build", F.col("n").alias("units"), ids.stable_id("bv", F.concat(ids.fields(F.col("build"), F.col("n")), ids.field_list(F.transform("us", lambda x: x["u"])))).alias("manifest_id"))


def numbered_units(units: DataFrame) -> DataFrame:
    """units with position, from 0, in the order of the manifest of their build."""
    return units.withColumn("position", F.row_number().over(Window.partitionBy("build").orderBy("path", F.array_join("arguments", "\0"))) - 1)


def successor_results(results: DataFrame, members: DataFrame, dag: DataFrame) -> DataFrame:
    """component, source, target and epistemic: the facts of a component's successors (src_scc, dst_scc), which support its
    own evaluation."""
    of = results.join(members.select(F.col("node").alias("source"), F.col("component").alias("dst_scc")), "source")
    return of.join(dag.select("src_scc", "dst_scc").distinct(), "dst_scc").select(F.col("src_scc").alias("component"), "source", "target", "epistemic")


def coverage(sites: DataFrame, unknown_effects: DataFrame) -> DataFrame:
    """function, sites, unresolved, weak (states other than MUST) and covered: whether no unknown is in its reach.

    sites: caller, callee (null where unresolved) and epistemic; unknown_effects: source, that reach one.
    """
    counts = sites.groupBy(F.col("caller").alias("function")).agg(F.count("*").alias("sites"), F.count_if(F.expr("callee IS NULL")).alias("unresolved"), F.count_if(F.expr("epistemic <> 1")).alias("weak"))
    open_ = unknown_effects.select(F.col("source").alias("function"), F.lit(False).alias("closed")).distinct()
    return counts.join(open_, "function", "left").select("function", "sites", "unresolved", "weak", F.coalesce("closed", F.lit(True)).alias("covered"))

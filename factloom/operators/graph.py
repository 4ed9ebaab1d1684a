"""Call graphs: adjacency, strongly connected components, condensation, topological levels and bounded paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.ids import NAMESPACE, field, field_list, stable_id
from factloom.functions.lattice import merged
from factloom.plans.closure import close
from factloom.plans.stage import Rounds, discard, materialize


def callees(edges: DataFrame, function) -> DataFrame:
    return edges.filter(F.col("src") == function).select(F.col("dst").alias("node")).distinct()


def callers(edges: DataFrame, function) -> DataFrame:
    return edges.filter(F.col("dst") == function).select(F.col("src").alias("node")).distinct()


def _shrunk(core: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """core without nodes on no cycle and with folded paths; what went is appended to ``gone``.

    A round takes off all nodes without callers or callees, and folds nodes with one of each (a > node > b becomes a > b) that
    come before both neighbours in an order by hash, so that no two neighbours fold. Long paths and cycles shrink by a third a
    round. A folded node is in its neighbours' component if they share one.
    """
    while True:
        none, order = F.lit(None).cast(core.schema["src"].dataType), lambda c: F.xxhash64(c, F.lit(len(gone)))  # noqa: B023
        ends = core.select(F.col("src").alias("node"), none.alias("a"), F.col("dst").alias("b")).union(core.select("dst", "src", none))
        seen = ends.groupBy("node").agg(F.count("a").alias("n_in"), F.count("b").alias("n_out"), F.min("a").alias("a"), F.min("b").alias("b"))
        between = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (order("node") < order("a")) & (order("node") < order("b"))
        less = materialize(seen.withColumn("folded", between).filter("folded OR n_in = 0 OR n_out = 0").select("node", "a", "b", "folded"), "scc-gone")
        if less.isEmpty():
            discard(less)
            return core
        gone.append(less)
        kept = core.join(less.select(F.col("node").alias("src")), "src", "left_anti").join(less.select(F.col("node").alias("dst")), "dst", "left_anti")
        folded = less.filter("folded AND a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        after = materialize(kept.unionByName(folded).distinct(), "scc-core")
        discard(core)
        core = after


def _split(core: DataFrame, labels: Rounds, turn: int) -> DataFrame:
    """core without the components of its pivots, which go to ``labels`` (node, low), and without edges between components.

    Each node takes the first node, in an order by hash, that reaches it; that one is a pivot, and its component is what reaches
    it among the nodes that took it. Nodes that took different pivots share no component.
    """
    spark = core.sparkSession
    nodes = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
    taken = Rounds(spark, "scc-taken")
    fresh = taken.add(nodes.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("place"), F.col("node").alias("pivot")).alias("first")))
    while not fresh.isEmpty():
        first = taken.all().groupBy("node").agg(F.min("first").alias("known"))
        step = core.join(fresh, core.src == fresh.node).groupBy(F.col("dst").alias("node")).agg(F.min("first").alias("first"))
        fresh = taken.add(step.join(first, "node").filter("first < known").select("node", "first"))
    own = materialize(taken.all().groupBy("node").agg(F.min("first").alias("first")).select("node", "first.pivot"), "scc-own")
    discard(taken.all())
    sides = core.join(own.withColumnsRenamed({"node": "src", "pivot": "low"}), "src").join(own.withColumnsRenamed({"node": "dst", "pivot": "other"}), "dst")
    inner = materialize(sides.filter("low = other").select("src", "dst", "low"), "scc-inner")
    back = Rounds(spark, "scc-back")
    fresh = back.add(own.filter("node = pivot").select("node", F.col("pivot").alias("low")))
    while not fresh.isEmpty():
        step = inner.join(fresh.select("node"), inner.dst == F.col("node")).select(F.col("src").alias("node"), "low").distinct()
        fresh = back.add(step.join(back.all().select("node"), "node", "left_anti"))
    done = labels.add(back.all())
    rest = inner.select("src", "dst").join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
    out = materialize(rest, "scc-core")
    discard(core, own, inner, back.all())
    return out


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) and scc_id of every node, from edges (src, dst).

    What lies on no cycle is taken off and paths are folded; what is left, usually little, is split by pivots, again and again.
    No step makes pairs of a component's nodes.
    """
    e = materialize(edges.select("src", "dst").distinct(), "scc-edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    labels, gone = Rounds(edges.sparkSession, "scc-labels"), []
    labels.add(e.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("low")))
    core = _shrunk(materialize(e.filter("src != dst"), "scc-core"), gone)
    for turn in count():
        if core.isEmpty():
            break
        core = _shrunk(_split(core, labels, turn), gone)
    for less in reversed(gone):
        folded = less.filter("folded")
        if not folded.isEmpty():
            side = lambda c: labels.all().select(F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
            sides = folded.join(side("a"), "a", "left").join(side("b"), "b", "left")
            sides = sides.select("node", F.coalesce("low_a", "a").alias("low"), F.coalesce("low_b", "b").alias("other"))
            labels.add(sides.filter("low = other").select("node", "low"))
    discard(core, *gone)
    rows = nodes.join(labels.all(), "node", "left").select("node", F.coalesce("low", "node").alias("low"))
    ids = rows.groupBy("low").agg(F.min("node").alias("component"), F.array_sort(F.collect_set(F.col("node").cast("string"))).alias("members"))  # a component's members
    ids = ids.select("low", "component", F.size("members").alias("size"), stable_id("scc", F.concat(field(F.lit(f"{NAMESPACE}.scc.v1")), field_list(F.col("members")))).alias("scc_id"))
    return rows.join(ids, "low").select("node", "component", "size", "scc_id")


def condensation(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src_scc, dst_scc and epistemic: edges between components, the weakest state of each, no loops."""
    part = members.select("node", "component")
    a = edges.join(part.withColumnsRenamed({"node": "src", "component": "src_scc"}), "src")
    b = a.join(part.withColumnsRenamed({"node": "dst", "component": "dst_scc"}), "dst").filter("src_scc != dst_scc")
    return merged(b, ["src_scc", "dst_scc"])


def recursive(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component and whether it is recursive: two members or more, or an edge to itself."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    return members.join(loops, "node", "left").groupBy("component").agg((F.max("size") > 1).alias("many"), F.max(F.coalesce("loop", F.lit(False))).alias("loop")).select("component", (F.col("many") | F.col("loop")).alias("recursive"))


def levels(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """component and level: 0 for components that call none, else one above the highest they call. Callee first."""
    done = materialize(nodes.select("component").distinct().withColumn("level", F.lit(0)), "levels")
    fresh = done
    while True:
        up = dag.join(fresh, dag.dst_scc == fresh.component).groupBy("src_scc").agg((F.max("level") + 1).alias("up")).withColumnRenamed("src_scc", "component")
        fresh = materialize(up.join(done, "component").filter("up > level").select("component", F.col("up").alias("level")), "levels-up")
        if fresh.isEmpty():
            return done
        done = materialize(done.unionByName(fresh).groupBy("component").agg(F.max("level").alias("level")), "levels")


def topological_order(dag: DataFrame, nodes: DataFrame) -> list:
    """All components, callee first, the smallest ready one next. On the driver: the order is one sequence by its nature."""
    import heapq

    calls: dict = {r["component"]: set() for r in nodes.select("component").distinct().toLocalIterator()}
    users: dict = {c: [] for c in calls}
    for r in dag.select("src_scc", "dst_scc").distinct().toLocalIterator():
        calls[r["src_scc"]].add(r["dst_scc"])
        users[r["dst_scc"]].append(r["src_scc"])
    ready, out = [c for c, to in calls.items() if not to], []
    heapq.heapify(ready)
    while ready:
        c = heapq.heappop(ready)
        out.append(c)
        for u in users[c]:
            calls[u].discard(c)
            if not calls[u]:
                heapq.heappush(ready, u)
    return out


def within(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, node, depth and epistemic of what each root (root) reaches in depth steps at most: shortest depth, weakest state."""
    e = materialize(merged(edges, ["src", "dst"]).withColumnRenamed("epistemic", "step"), "path-edges")
    seen = materialize(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "paths")
    fresh = seen
    for d in range(1, depth + 1):
        more = e.join(fresh, e.src == fresh.node).select("root", F.col("dst").alias("node")).distinct()
        fresh = materialize(more.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)), "paths-new")
        if fresh.isEmpty():
            break
        seen = materialize(seen.unionByName(fresh), "paths")
    return seen


def shortest_path(edges: DataFrame, src, dst, max_depth: int = 10, max_nodes: int = 1000, max_paths: int = 1000) -> dict:
    """One shortest path (ties by its nodes) with the budget's verdict: path, nodes, truncated, reasons."""
    reasons: list[str] = []
    if max_paths == 0:
        return {"path": None, "nodes": 0, "truncated": True, "reasons": ["MAX_PATHS"]}
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    front = spark.createDataFrame([(src, [src])], f"node {kind.simpleString()}, path array<{kind.simpleString()}>")
    seen = front.select("node")
    for depth in range(max_depth + 1):
        hit = front.filter(F.col("node") == dst).orderBy("path").first()
        n = seen.count()
        if hit:
            return {"path": list(hit["path"]), "nodes": n, "truncated": False, "reasons": reasons}
        step = edges.join(front, edges.src == front.node).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        step = materialize(step.join(seen, "node", "left_anti"), "front")
        if step.isEmpty():
            return {"path": None, "nodes": n, "truncated": False, "reasons": reasons}
        if depth == max_depth:
            reasons.append("MAX_DEPTH")
            break
        if n + step.count() > max_nodes:
            reasons.append("MAX_NODES")
            break
        front, seen = step, materialize(seen.unionByName(step.select("node")), "seen")
    return {"path": None, "nodes": seen.count(), "truncated": True, "reasons": reasons}


def taint(flows: DataFrame, sources: DataFrame, blocked: DataFrame) -> DataFrame:
    """source and target: what tainted sources (node) reach through flows that are not blocked (src, dst). Negation is on
    a base relation, so it is taken before the closure."""
    open_ = flows.join(blocked, ["src", "dst"], "left_anti")
    seed = open_.join(sources.withColumnRenamed("node", "src"), "src", "left_semi")
    return close(open_.select("src", "dst", "epistemic"), open_.select(F.col("src").alias("source"), F.col("dst").alias("target"), "epistemic")).facts.join(seed.select(F.col("src").alias("source")).distinct(), "source", "left_semi")


def impact(dependencies: DataFrame, seeds: DataFrame, max_depth: int | None = 16, max_consumers: int | None = 1000) -> tuple[DataFrame, bool]:
    """Consumers (consumer, depth) that seeds (producer, sensitivity) reach, and whether a budget cut the search.

    An edge is followed only if its sensitivity is that of the change. Without max_depth the search ends at the empty
    frontier. The least ``max_consumers`` by depth and name stay.
    """
    d = materialize(dependencies.select("consumer", "producer", "sensitivity").distinct(), "deps")
    front = seeds.select("producer", "sensitivity").distinct()
    seen = None
    truncated = False
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = d.join(front, ["producer", "sensitivity"]).select("consumer", "sensitivity").distinct()
        if seen is not None:
            step = step.join(seen.select("consumer", "sensitivity"), ["consumer", "sensitivity"], "left_anti")
        step = materialize(step.withColumn("depth", F.lit(depth)), "impact")
        if step.isEmpty():
            break
        seen = step if seen is None else seen.unionByName(step)
        front = step.select(F.col("consumer").alias("producer"), "sensitivity")
    else:
        truncated = not d.join(front, ["producer", "sensitivity"]).join(seen.select("consumer", "sensitivity"), ["consumer", "sensitivity"], "left_anti").isEmpty()
    if seen is None:
        return d.select("consumer", F.lit(0).alias("depth")).limit(0), False
    found = materialize(seen.groupBy("consumer").agg(F.min("depth").alias("depth")), "consumers")
    if max_consumers is None:
        return found, truncated
    truncated = truncated or found.count() > max_consumers
    return found.orderBy("depth", "consumer").limit(max_consumers), truncated


def points_to(address_of: DataFrame, copies: DataFrame, stores: DataFrame, loads: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """var and obj: inclusion-based points-to of address_of (var, obj), copies (dst, src), stores (ptr, src), loads (dst, ptr)."""
    total = materialize(address_of.select("var", "obj").distinct(), "pts")
    for _ in range(max_rounds):
        p = total.select(F.col("var").alias("pv"), F.col("obj").alias("po"))
        q = total.select(F.col("var").alias("qv"), F.col("obj").alias("qo"))
        by_copy = copies.join(p, copies.src == p.pv).select(F.col("dst").alias("var"), F.col("po").alias("obj"))
        by_store = stores.join(p, stores.ptr == p.pv).join(q, stores.src == q.qv).select(F.col("po").alias("var"), F.col("qo").alias("obj"))
        by_load = loads.join(p, loads.ptr == p.pv).join(q, F.col("po") == q.qv).select(F.col("dst").alias("var"), F.col("qo").alias("obj"))
        new = materialize(by_copy.union(by_store).union(by_load).distinct().join(total, ["var", "obj"], "left_anti"), "pts-new")
        if new.isEmpty():
            return total
        total = materialize(total.union(new), "pts")
    raise RuntimeError(f"points-to has no fixpoint after {max_rounds} rounds")

"""Near duplicates by bottom-k sketches of one hash function.

The k smallest hashes of a document's shingles are its sketch. Inverted lists of the retained values that two or more
different sets share give the candidates, the sketch of a pair's union estimates its similarity, and exact Jaccard over
whole sets decides. Steps:

1. Rows with equal sets form a class at once; only one row of each class goes on, so copies never make pairs.
2. The LISTED smallest values of each sketch are listed. Values in one class alone are dropped, and a pair as similar as
   asked shares at least ``least_shared`` of the rest, so a class is listed only under its first few by rarity.
3. The whole sets of the listed classes are computed once and written in buckets by class, so that later joins move the
   pairs to the sets and not the sets to the pairs.
4. Each list has a hub, the member whose values are the most common. Every member is compared with the hub: pairs grow
   with the lists' lengths, not their squares. Linked members merge. In lists of more than SHORT members that still hold
   several components, all that lie apart from one of the next HUBS - 1 members in that order are compared with it.
5. Lists that still hold several components: those of at most SHORT members compare all of them across components, a
   bounded number for each member. The members of longer ones go through an exact prefix join over their whole sets.
   Either way no link between components of a list is lost.
6. Components of at most LOCAL_LINKS links are found in the driver, 16 bytes a link; those of more come from alternating
   large-star and small-star rounds, until nothing changes. Steps that have no list left to look at are left out.

Two sets as similar as asked share fewer listed values than ``least_shared`` with a chance under LOSS, and their union
sketch estimates less than MARGIN below the bar with one under 1e-8 (both binomial); sets smaller than the sketch are
listed without loss. tests/llm hold the groups against all pairs.

Keys with many rows are split: copies and hubs meet their class by joins of two shuffles, which Spark splits by size.

Defined cases: a null or blank text has no shingles, n_shingles 0 and is linked with nothing. A row without doc_id is linked
with nothing, its component is null and it is kept. Rows that share a doc_id are one document: their links add up, and all
of them get its component. A text of any length is one set, held whole by one task; the longest one sets the memory that a
worker needs (about 100 bytes for each of its words). Columns other than doc_id and text are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.textvec import LOWER, Words, blocks, column_bytes, mix64, shingles, worker_state
from factloom.plans.stage import bucketed, discard, materialize

#: Values of a sketch, those of them that are listed, and members of a list that are all compared with each other.
SKETCH, LISTED, SHORT = 64, 16, 16
#: Hubs of a longer list.
HUBS = 4
#: Chance that a similar pair shares too few listed values; how far an estimate may lie under the bar.
LOSS, MARGIN = 1e-7, 0.3
#: Keys that are broadcast at most, some 85 bytes each as a hash table.
BROADCAST_KEYS = 250_000
#: Links whose components the driver finds at most.
LOCAL_LINKS = 250_000
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85


def _sets(text: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    w = Words(text, at)
    h, row = shingles(w.hashes(LOWER), w.row, len(at) - 1, size)
    ends = np.searchsorted(row, np.arange(len(at)))
    for i in range(len(at) - 1):
        yield np.unique(h[ends[i] : ends[i + 1]])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, k: int = SKETCH, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the whole set) and sketch (its k smallest hashes) of whole texts."""
    schema = "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, None)
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            for text, offsets, row in blocks(data, at):
                n, d1, d2, kept = [], [], [], []
                for s in _sets(text, offsets, size):
                    n.append(len(s))
                    d1.append(mix64(s).sum(dtype=np.uint64))
                    d2.append(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    kept.append(s[:k].copy())
                digests = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)]
                columns = [batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), *digests, _lists(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, k: int = SKETCH, size: int = 5) -> DataFrame:
    """key, n, sketch and whole: the sorted distinct hashes of all shingles of each text (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            for text, offsets, row in blocks(data, at):
                sets = list(_sets(text, offsets, size))
                n = pa.array([len(s) for s in sets], pa.int32())
                columns = [batch.column(0).slice(row, len(sets)), n, _lists([s[:k] for s in sets]), _lists(sets)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "sketch", "whole"])

    return docs.mapInArrow(run, "key long, n int, sketch array<long>, whole array<long>")


def least_of(k: int, share: float, loss: float = LOSS) -> int:
    """The largest r such that fewer than r of k values are shared with a chance of at most ``loss``; 1 at least."""
    below, r = 0.0, 0
    while r < k and below + (term := math.comb(k, r) * share**r * (1 - share) ** (k - r)) <= loss:
        below, r = below + term, r + 1
    return max(1, r)


def least_shared(n: Column, listed: int = LISTED, percent: int = PERCENT) -> Column:
    """Listed values that a set of n shingles shares with any similar one, at least."""
    t = percent / 100
    # A smaller set is listed whole; of a similar one, at most n / t - listed values are not.
    small = F.floor(n * t - F.greatest(F.lit(0.0), n / F.lit(t) - listed)).cast("int")
    return F.when(n >= listed, F.lit(least_of(listed, t))).otherwise(F.greatest(F.lit(1), small))


def apart(column: str) -> Column:
    """The column's values, in a form whose partitioning Spark does not know, so that a join shuffles both of its sides;
    only then does it split a key with many rows."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long")).alias(column)


def classes(sketched: DataFrame) -> DataFrame:
    """n_shingles, d1, d2, key (smallest doc_id) and sketch, a row for each set; rows without shingles or doc_id are left out."""
    real = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    return real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("key"), F.first("sketch").alias("sketch"))


def postings(cls: DataFrame, listed: int = LISTED, percent: int = PERCENT) -> DataFrame:
    """key, n and listed: the values under which a class must be found."""
    each = cls.select("key", F.col("n_shingles").cast("int").alias("n"), F.explode(F.slice("sketch", 1, listed)).alias("v"))
    counts = each.groupBy("v").agg(F.count("*").cast("int").alias("df")).filter("df > 1").select(apart("v"), "df")
    values = F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs")  # at most ``listed``
    shared = each.join(counts, "v").groupBy("key", "n").agg(values)
    first = shared.withColumn("m", F.size("vs") - least_shared(F.col("n"), listed, percent) + 1).filter("m > 0")
    return first.select("key", "n", F.transform(F.slice("vs", F.lit(1), F.greatest(F.col("m"), F.lit(0))), lambda e: e["v"]).alias("listed"))


def with_commonness(lists: DataFrame, cls: DataFrame) -> DataFrame:
    """lists with shared: how common the values of the class's whole sketch are among the listed classes."""
    each = cls.join(lists.select("key"), "key", "left_semi").select("key", F.explode("sketch").alias("v"))
    counts = each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").select(apart("v"), "df")
    weight = F.floor(F.log2("df") * 1024)  # whole numbers, so that the order of the sum changes nothing
    shared = each.join(counts, "v").groupBy("key").agg(F.sum(weight).alias("shared"))
    return lists.join(shared, "key", "left").select("key", "n", "listed", F.coalesce("shared", F.lit(0)).alias("shared"))


def _union_estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity of two sets by the bottom-k sketch of their union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _similar(percent: int) -> Column:
    both = F.size(F.array_intersect("wa", "wb"))
    return both * 100 >= (F.size("wa") + F.size("wb") - both) * percent


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that are similar: union sketches first, then whole sets. Many pairs may have one b, not one a."""

    def met(some: DataFrame, column: str, *more: Column) -> DataFrame:
        # First the sets of a, where they lie; then both sides move to b, each set of b once.
        left = some.join(sets.select(F.col("key").alias("a"), F.col(column).alias("wa"), *[m.alias("na") for m in more]), "a")
        asked = some.select(F.col("b").alias("key")).distinct().join(sets, "key")
        return left.join(asked.select(apart("key").alias("b"), F.col(column).alias("wb"), *[m.alias("nb") for m in more]), "b")

    likely = met(pairs, "sketch", F.col("n")).filter(_sizes_fit(F.col("na"), F.col("nb"), percent))
    likely = likely.filter(_union_estimate(F.col("wa"), F.col("wb"), k) >= percent / 100 - MARGIN)
    likely = materialize(likely.select("a", "b"), f"likely-{name}")
    links = materialize(met(likely, "whole").filter(_similar(percent)).select("a", "b"), f"links-{name}")
    discard(likely)
    return links


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the edges (u, v) and the smallest key that each reaches."""
    keys, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(keys))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return keys, keys[root]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def components(links: DataFrame) -> DataFrame:
    """key and comp (smallest key reachable) of all keys in links (a, b); in the driver where these are few, else by large-star
    and small-star in turn, to the end."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges, mark = materialize(edges, "edges"), None
    if edges.count() <= LOCAL_LINKS:
        few = edges.toArrow()
        discard(edges)
        keys, comp = least_reachable(few.column("u").to_numpy(), few.column("v").to_numpy())
        return links.sparkSession.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "comp": pa.array(comp, pa.int64())}), "key long, comp long")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(apart("u"), "m")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        discard(edges)
        edges = new
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    own = edges.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.col("m").alias("comp")).union(own)


def near_duplicates(docs: DataFrame, k: int = SKETCH, percent: int = PERCENT, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    hashed = materialize(sketches(docs, k, size), "sketches")
    cls = materialize(classes(hashed), "classes")
    named = ["n_shingles", "d1", "d2"]
    rows = hashed.select("doc_id", *named)
    placed = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(cls.select(*named, "key"), named)
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("key", F.lit(None).cast("long"))
    placed = materialize(placed.select("doc_id", "n_shingles", "key").union(alone.select("doc_id", "n_shingles", "key")), "placed")
    discard(hashed)
    found = materialize(postings(cls, LISTED, percent), "postings")
    lists = materialize(with_commonness(found, cls), "lists")
    discard(cls, found)
    asked = lists.select("key")
    # Texts move to the keys only where these are too many to go to the texts.
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(asked, "key", "left_semi")
    # Rows that share a doc_id may hold other sets than the class that it names: only that set counts here.
    sets = whole_sets(texts, k, size).join(lists.select("key", F.col("listed").alias("l"), F.col("n").alias("m")), "key")
    sets = sets.filter((F.col("n") == F.col("m")) & (F.size(F.array_except("l", "sketch")) == 0)).select("key", "n", "sketch", "whole")
    sets = bucketed(sets, "key", "sets")
    spread = lists.select("key", "n", "shared", F.explode("listed").alias("v"))
    top = spread.groupBy("v").agg(F.max(F.struct("shared", (-F.col("key")).alias("minus"))).alias("hub"), F.count("*").alias("c"))
    hubs = top.filter("c > 1").select(apart("v"), (-F.col("hub.minus")).alias("b"))
    star = spread.join(hubs, "v").filter("key != b").select(F.col("key").alias("a"), "b").distinct()
    first = verified(star, sets, k, percent, "hubs")
    merged = materialize(components(first), "merged")
    open_ = materialize(open_members(spread, merged), "open")
    old = [first]
    if not open_.filter(F.col("c") > SHORT).isEmpty():
        second = verified(next_hubs(open_, percent), sets, k, percent, "next-hubs")
        first, old = first.union(second), [first, second, merged, open_]
        merged = materialize(components(first), "merged")
        open_ = materialize(open_members(spread, merged), "open")
    rest = [verified(short_pairs(open_, percent), sets, k, percent, "short")]
    longer = open_.filter(F.col("c") > SHORT)
    if not longer.isEmpty():
        rest.append(long_links(longer.select("key", "comp").distinct(), sets, k, percent))
    real = placed.filter("key IS NOT NULL")
    several = real.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a != z").select(apart("doc_id"), "a")
    again = real.join(several, "doc_id").select("a", F.col("key").alias("b")).distinct()
    links = reduce(DataFrame.union, rest, first).union(again).union(merged.select(F.col("comp").alias("a"), F.col("key").alias("b")))
    final = materialize(components(links.filter("a != b")), "components")
    discard(sets, lists, open_, merged, *rest, *old)
    known = real.join(final, "key", "left").select("doc_id", "n_shingles", F.coalesce("comp", "key").alias("component_id"))
    blank = placed.filter("key IS NULL AND doc_id IS NOT NULL").select("doc_id", "n_shingles")
    elsewhere = known.select("doc_id", F.col("component_id").alias("c")).distinct()
    blank = blank.join(elsewhere, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    lost = placed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return known.union(blank).union(lost).withColumn("kept", kept)


def open_members(spread: DataFrame, merged: DataFrame) -> DataFrame:
    """v, key, n, shared, comp and c (members of the list) of the lists that still hold several components."""
    at = spread.join(merged, "key", "left").select("v", "key", "n", "shared", F.coalesce("comp", "key").alias("comp"))
    parts = at.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"))
    return at.join(parts.filter("low != high").select(apart("v"), "c"), "v")


def next_hubs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the members of longer lists and their next hubs b, across components."""
    lists = open_.filter(F.col("c") > SHORT)
    order = Window.partitionBy("v").orderBy(F.desc("shared"), "key")
    hubs = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS)
    hubs = hubs.filter("rank > 1").select(apart("v"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    met = lists.join(hubs, "v").filter((F.col("comp") != F.col("cb")) & _sizes_fit(F.col("n"), F.col("nb"), percent))
    return met.select(F.col("key").alias("a"), "b").distinct()


def short_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) across components of the lists of at most SHORT members: under SHORT for each member of a list."""
    lists = open_.filter(F.col("c") <= SHORT)
    a = lists.select("v", F.col("key").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = lists.select("v", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return a.join(b, "v").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _sizes_fit(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def long_links(members: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The similar pairs (a, b) of members (key, comp) across components, by a prefix join over whole sets.

    Shingles are ordered by how many members have them. Similar sets share one of the first n - need + 1 of that order,
    and the first that they share leaves room for the overlap that their sizes ask for; a pair is made at that one only.
    Shingles that no other member has stand first and make no pair, so a set with too many of them drops out.
    """
    each = sets.join(members.select("key"), "key").select("key", "n", F.explode("whole").alias("v"))
    counts = each.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").select(apart("v"), "df")
    ordered = each.join(counts, "v").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    first = ordered.withColumn("m", F.size("vs") - need + 1).filter("m > 0").join(members, "key")
    values = F.transform(F.slice("vs", F.lit(1), F.greatest(F.col("m"), F.lit(0))), lambda e: e["v"]).alias("l")
    first = first.select("key", "n", "comp", values, (F.col("n") - F.size("vs")).alias("alone"))
    places = first.select("key", "n", "comp", "l", "alone", F.posexplode("l").alias("p", "v"))
    places = materialize(places.withColumn("p", F.col("p") + F.col("alone")).drop("alone"), "places")

    def side(x: str) -> DataFrame:
        names = {"v": "v", "key": "", "n": "n", "comp": "c", "l": "l", "p": "p"}
        return places.select(*[F.col(c).alias(p + x) for c, p in names.items()])

    room = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent)) >= (F.col("na") + F.col("nb")) * percent
    once = F.get(F.array_intersect("la", "lb"), F.lit(0)) == F.col("va")
    across = (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    pairs = side("a").join(side("b"), across & _sizes_fit(F.col("na"), F.col("nb"), percent) & room & once)
    pairs = materialize(pairs.select("a", "b"), "long-pairs")
    links = verified(pairs, sets, k, percent, "long")
    discard(places, pairs)
    return links


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Shingles as texts and all pairs that share one: a check for small tables, not a way to do it.
SQL10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS s
      FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 4, 1)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT o.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.c AS component_id, o.doc_id = m.c AS kept
FROM documents o LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

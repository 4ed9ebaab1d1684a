"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse vectors of integer weights; a term is a position. Queries go in blocks of bounded size to every task; for
each block of candidates a task lists the postings of each term, scatters query weight times posting weight into a dense
array of scores, selects the k best of each query, and merges them with its best so far. One shuffle of k rows for each
query and task merges the tasks. Memory follows the components that are not 0, and blocks are bounded by components.

Defined cases: vectors that are null or hold a null or a component that is not finite take no part. Terms that a shorter
vector lacks weigh nothing; an empty vector scores 0 with all. Rows that share an id are separate candidates, and none of
them meets a query with its own id; query rows that share an id are separate queries, each with its own k rows. Rows
without an id take no part. Ties go to the smaller id. Scores are exact 64-bit sums, whatever the sums on the way; a score
or component that no 64-bit integer holds counts as the nearest one that does, down to -(2^63 - 1). Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stage import materialize, new_path

#: Queries broadcast at once (about), and their components; candidates scored at once, and queries scored at once.
QUERY_BLOCK, QUERY_TERMS, CANDIDATES, QUERIES = 4_096, 4_000_000, 1_024, 128
#: The largest score and component, and what stands for no score.
MOST, NONE = 2**63 - 1, -(2**63)


def quantised(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id and q: floor(scale * component) of the vectors that take part."""
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    edge = F.lit(2.0**63)

    def whole(v: Column) -> Column:
        y = v.cast("double") * scale
        return F.when(y >= edge, F.lit(MOST)).when(y <= -edge, F.lit(-MOST)).otherwise(F.floor(F.when(F.abs(y) < edge, y)))

    return vectors.filter(x.isNotNull() & F.col(f"`{ids}`").isNotNull()).filter(sound).select(F.col(f"`{ids}`").cast("long").alias("id"), F.transform(x, whole).alias("q"))


class Postings:
    """The components of some rows that are not 0, term by term."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.n = len(sizes)
        row = np.repeat(np.arange(self.n), sizes)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        real = np.flatnonzero(flat)
        real = real[np.argsort(term[real], kind="stable")]
        self.row, self.weight = row[real], flat[real]
        self.terms, self.start = np.unique(term[real], return_index=True)
        self.end = np.append(self.start[1:], len(real))
        size = np.abs(self.weight.astype(float))
        #: Upper bounds of any component, and of the sum of a row's components.
        self.most = size.max(initial=0.0)
        self.total = np.bincount(self.row, size, self.n).max(initial=0.0)


def accumulate(queries: Postings, candidates: Postings) -> np.ndarray:
    """Scores of all queries with all candidates, a term at a time."""
    bound = min(queries.total * candidates.most, queries.most * candidates.total)
    kind = np.int32 if bound < 2**30 else np.int64
    scores = _accumulated(queries, candidates, kind)
    if bound < 2**62:
        return scores.astype(np.int64)
    # Sums modulo 2^64 are right where the score fits; where it may not, it is counted in whole numbers of any size.
    about = _accumulated(queries, candidates, np.float64, absolute=True)
    for i, j in zip(*np.nonzero(about >= 2.0**62), strict=True):
        a, b = ({int(t): int(p.weight[s + k]) for t, s, e in zip(p.terms, p.start, p.end, strict=True) if (k := np.searchsorted(p.row[s:e], r)) < e - s and p.row[s + k] == r} for p, r in ((queries, i), (candidates, j)))
        scores[i, j] = max(-MOST, min(MOST, sum(w * b.get(t, 0) for t, w in a.items())))
    return scores


def _accumulated(queries: Postings, candidates: Postings, kind, absolute: bool = False) -> np.ndarray:
    scores = np.zeros((queries.n, candidates.n), kind)
    product = np.empty_like(scores)
    q, c = queries.weight.astype(kind), candidates.weight.astype(kind)
    q, c = (np.abs(q), np.abs(c)) if absolute else (q, c)
    both, i, j = np.intersect1d(queries.terms, candidates.terms, assume_unique=True, return_indices=True)
    with np.errstate(over="ignore"):
        for a, b in zip(i, j, strict=True):
            mine, theirs = slice(queries.start[a], queries.end[a]), slice(candidates.start[b], candidates.end[b])
            rows, columns = queries.row[mine], candidates.row[theirs]
            if len(rows) == queries.n and len(columns) == candidates.n:
                scores += np.multiply.outer(q[mine], c[theirs], out=product)
            else:
                scores[np.ix_(rows, columns)] += np.multiply.outer(q[mine], c[theirs])
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates of each query; a score of NONE stands for no candidate. Ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    n = scores.shape[1]
    scores[own[:, None] == ids[None]] = NONE
    k = min(k, n)
    if n > k:
        # All above the k-th score, then those equal to it by id: the k first of a stable order of a partition.
        bar = np.partition(scores, n - k, axis=1)[:, n - k]
        above = scores > bar[:, None]
        equal = scores == bar[:, None]
        room = k - above.sum(axis=1)
        picked = above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
        at = np.nonzero(picked)[1].reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(n), (len(scores), n))
    return np.take_along_axis(scores, at, axis=1), ids[at]


FOUND = "query long, query_id long, id long, score long"


def _ranked(queries: DataFrame, candidates: DataFrame, k: int, out: str, first: int) -> None:
    """Scans all candidates for one block of queries, numbered from ``first``, and appends each task's best."""
    rows = queries.collect()  # about QUERY_BLOCK rows and QUERY_TERMS components
    if not rows:
        return
    own = np.array([r["id"] for r in rows], np.int64)
    blocks = []
    for b in range(0, len(rows), QUERIES):
        some = rows[b : b + QUERIES]
        flat = [np.array(r["q"], np.int64) for r in some]
        blocks.append((np.array([len(f) for f in flat]), np.concatenate(flat)))
    shared = candidates.sparkSession.sparkContext.broadcast((own, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = shared.value
        queries = [Postings(*b) for b in blocks]
        kept_s, kept_i = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, CANDIDATES):
                some = batch.slice(a, CANDIDATES)
                ids, lists = some.column(0).to_numpy(zero_copy_only=False), some.column(1)
                c = Postings(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False))
                found = [best(accumulate(q, c), ids, own[b * QUERIES : (b + 1) * QUERIES], k) for b, q in enumerate(queries)]
                s = np.concatenate([kept_s, np.concatenate([f[0] for f in found])], axis=1)
                i = np.concatenate([kept_i, np.concatenate([f[1] for f in found])], axis=1)
                # ~s falls as s rises, also where -s would not fit.
                at = np.lexsort((i, ~s), axis=1)[:, :k]
                kept_s, kept_i = np.take_along_axis(s, at, axis=1), np.take_along_axis(i, at, axis=1)
        who, col = np.nonzero(kept_s > NONE)
        columns = [pa.array(who + first, pa.int64()), pa.array(own[who]), pa.array(kept_i[who, col]), pa.array(kept_s[who, col])]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "id", "score"])

    candidates.mapInArrow(run, FOUND).write.mode("append").parquet(out)
    shared.unpersist()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors: id and q. The k best candidates of each row for which is_query holds: query_id, rank, id and score."""
    spark = vectors.sparkSession
    queries = vectors.filter(is_query)
    n = queries.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-n["rows"] // QUERY_BLOCK), -(-n["terms"] // QUERY_TERMS))
    out = new_path(spark, "top-k")
    spark.createDataFrame([], FOUND).write.parquet(out)
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id", "q"), F.lit(blocks)) == b).orderBy("id", "q")
        _ranked(block, vectors, k, out, b << 40)
    found = spark.read.schema(FOUND).parquet(out)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, F.col("id") % 50 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

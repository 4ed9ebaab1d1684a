"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Whole texts become hashed counts of words, of byte-class trigrams and of the shapes of neighbouring words. A singular value
decomposition of a bounded sample of labelled texts (FIT_ROWS, a parameter) gives the latent space. Its vectors and labels
are broadcast; every document's vector is multiplied with all of them, block by block, and its NEIGHBOURS nearest vote
with weights that rise with their cosine.

Defined cases: a null or empty text has a zero vector, whose cosines are all 0, so all labelled vectors vote alike for it:
it gets their mean label. All labelled vectors whose cosine equals that of the last neighbour vote as well, so ties need no
order. Rows without doc_id are held out. Repeated labels of a document count once, by the larger; of a labelled doc_id that
repeats, the smallest text counts. Without labels every score is 0.5. An empty table gives no rows. A very long text is
counted whole, in about 40 bytes of memory for each of its own. Other columns are passed on untouched by scored(), whatever
their names, but for one named as the score that the caller chooses, which is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.textvec import LOWER, Words, mix64
from factloom.llm.toxicity import by_block, labelled_sample

#: Labelled vectors, hashed dimensions of each kind, latent dimensions, and neighbours that vote.
FIT_ROWS, DIMS, LATENT, NEIGHBOURS = 4_000, 384, 48, 25
KINDS = 3
#: A neighbour's vote weighs exp(SHARPNESS * cosine).
SHARPNESS = 12.0
#: Cosines that are no further apart are equal.
TIE = 1e-6
#: Texts handled at once, so that the dense arrays stay small whatever their lengths.
ROWS = 512

_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(" \n\t.,;:!?'\"-()[]{}/\\@#*$%&|<>=+_~^`"):
    _CLASS[ord(_c)] = 5 + _i


def counts(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed counts of each text, KINDS * DIMS wide; each kind dampened by its square root and scaled to length 1."""
    n = len(at) - 1
    w = Words(text, at)
    h = w.hashes(LOWER)
    parts = [(w.row, h % np.uint64(DIMS))]
    c = _CLASS[text]
    rows = np.repeat(np.arange(n), np.diff(at))
    if len(c) > 2:
        same = rows[2:] == rows[:-2]
        tri = mix64(c[2:] * np.uint64(4096) + c[1:-1] * np.uint64(64) + c[:-2])
        parts.append((rows[2:][same], tri[same] % np.uint64(DIMS)))
    else:
        parts.append((rows[:0], rows[:0].astype(np.uint64)))
    size = np.minimum(w.end - w.start, 15).astype(np.uint64)
    shape = (c[w.start] * np.uint64(64) + c[w.end - 1]) * np.uint64(16) + size if len(h) else h
    if len(h) > 1:
        pair = w.row[1:] == w.row[:-1]
        joint = mix64(shape[1:] * np.uint64(1 << 20) + shape[:-1] * np.uint64(2) + (h[1:] == h[:-1]).astype(np.uint64))
        parts.append((w.row[1:][pair], joint[pair] % np.uint64(DIMS)))
    else:
        parts.append((rows[:0], rows[:0].astype(np.uint64)))
    out = np.zeros((n, KINDS * DIMS), np.float32)
    for k, (row, dim) in enumerate(parts):
        x = np.sqrt(np.bincount(row * DIMS + dim.astype(np.int64), minlength=n * DIMS).reshape(n, DIMS).astype(np.float32))
        out[:, k * DIMS : (k + 1) * DIMS] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


class Space:
    """The latent space, and the labelled vectors in it."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.mean, self.axes, self.vectors, self.labels = mean, axes, vectors, labels

    def project(self, x: np.ndarray) -> np.ndarray:
        has = (x != 0).any(axis=1)
        v = (x - self.mean) @ self.axes
        v[~has] = 0
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The weighted mean label of each text's nearest labelled vectors."""
        out = np.full((len(at) - 1, 1), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(at) - 1, ROWS) if k else ():
            some = at[a : a + ROWS + 1]
            v = self.project(counts(text[some[0] : some[-1]], some - some[0]))
            cosine = v @ self.vectors.T
            bar = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            weight = np.where(cosine >= bar[:, None] - TIE, np.exp(SHARPNESS * cosine.astype(float)), 0.0)
            score = weight @ self.labels / weight.sum(axis=1)
            out[a : a + len(score), 0] = np.where((v == 0).all(axis=1), self.labels.mean(), score)
        return np.clip(out, 0.0, 1.0)


def latent(x: np.ndarray, y: np.ndarray) -> Space:
    """The space of the strongest axes of the rows of x, from the eigenvectors of their covariance."""
    x = x.astype(np.float32)
    mean = x.mean(axis=0)
    centred = x - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    space = Space(mean, axes[:, ::-1][:, :LATENT].astype(np.float32), np.zeros((0, LATENT), np.float32), y)
    space.vectors = space.project(x).astype(np.float32)
    return space


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Space:
    sample = labelled_sample(docs, labels, "quality", training(F.col("doc_id")), fit_rows)
    flat = [T.StructField("v", T.BinaryType())]

    def pack(text, at):
        return np.array([[counts(text[a:b], np.array([0, b - a])).astype(np.float16).tobytes()] for a, b in zip(at[:-1], at[1:], strict=True)], object)

    rows = by_block(sample, flat, pack, ["doc_id", "label"]).orderBy("doc_id").collect()  # about fit_rows rows
    width = KINDS * DIMS
    if not rows:
        return Space(np.zeros(width, np.float32), np.zeros((width, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0))
    return latent(np.stack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32), np.array([float(r["label"]) for r in rows]))


def scored(docs: DataFrame, space: Space, name: str = "_good", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if none are named) with ``name``: the vote for each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((space.mean, space.axes, space.vectors, space.labels))  # about FIT_ROWS vectors
    made: list = []

    def per_block(text, at):
        if not made:
            made.append(Space(*shared.value))
        return made[0].vote(text, at)

    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    return by_block(docs, [T.StructField(name, T.DoubleType())], per_block, keep)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    space = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = scored(docs, space, "score", ["doc_id"])
    return d.select("doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

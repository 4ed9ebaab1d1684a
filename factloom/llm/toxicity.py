"""Toxicity: boosted trees over dense features (lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates), calibrated by isotonic regression.

The lexicon has a fixed part and one learned from the labelled rows: beginnings of words (4, 5, 6 and 8 bytes) that stand
in toxic documents far more often than chance allows. A bounded hash sample of labelled rows (FIT_ROWS, a parameter) is
split by hash: half of it gives the lexicon, the other half the trees. They are calibrated on margins out of fold: for each
of FOLDS parts of that half, trees grown on the others give its margins. The rule is the same at every size. Features of
every whole text come from vectorised scans of its bytes; trees and calibration are SQL expressions.

Defined cases: a null or empty text has all features 0 and gets the score of such a row. Rows without doc_id are held out.
Repeated labels of a document count once, by the larger; of a labelled doc_id that repeats, the smallest text counts.
Without labels of both kinds every score is 0 (or 1, if all labels are 1). An empty table gives no rows. A very long text
is scanned whole, in about 30 bytes of memory for each of its own. Other columns are passed on untouched by scored(),
whatever their names, but for one named as the score that the caller chooses, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import gbt
from factloom.llm.textvec import LOWER, PUNCTUATION, Words, blocks, column_bytes, fresh, mix64, worker_state
from factloom.plans.stage import materialize

FIT_ROWS = 24_000
#: Parts for margins out of fold.
FOLDS = 3
#: Common insults.
INSULTS = "asshole bastard bitch clown cretin crétin débile disgusting dumb dumm fool garbage idiot idiota imbécil imbécile imbecile jerk loser moron pathetic scum stupid tonto trash trottel worthless".split()
#: Words of the second person.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti usted ustedes vosotros su".split()
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
FOLDED = LOWER.copy()
for _a, _b in LEET.items():
    FOLDED[ord(_a)] = ord(_b)
PREFIXES = (4, 5, 6)
FEATURES = ("words", "strong", "strong_density", "weak_density", "insults", "insult_density", "weight", "weight_density", "near_second", "capitals", "exclaims", "punctuation", "digits", "obfuscated", "spelled")
#: Words between a lexicon word and a word of the second person at most.
NEAR = 6


def _hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of whole words, as Words.hashes() gives them for texts."""
    return np.unique(Words(*column_bytes(pa.array([" ".join(words)]))).hashes(LOWER))


INSULT_WORDS, SECOND_WORDS = _hashes(INSULTS), _hashes(SECOND_PERSON)


def word_keys(codes: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, key) for each prefix length that a word has, and for the whole word."""
    for n in PREFIXES:
        which = np.flatnonzero(size >= n)
        yield which, mix64((codes[which] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    which = np.flatnonzero(size >= 3)
    yield which, hashes[which]


class Lexicon:
    """Sorted keys with weights, and a table of their low bits that settles most lookups at once."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, strong: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.strong = keys[order], weights[order], strong[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in key that are in the lexicon, their places in it)."""
        maybe = np.flatnonzero(self.bits[(key & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        real = self.keys[place] == key[maybe]
        return maybe[real], place[real]

    def score(self, codes: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest weight, strong or not) of each word; a word has weight 0 if neither it nor a beginning of it is listed."""
        weight, strong = np.zeros(len(codes)), np.zeros(len(codes), bool)
        for which, key in word_keys(codes, hashes, size):
            found, place = self.find(key)
            np.maximum.at(weight, which[found], self.weights[place])
            strong[which[found]] |= self.strong[place]
        return weight, strong


def _within(listed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return listed[place] == hashes


def features(text: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(at) - 1
    w = Words(text, at, PUNCTUATION)
    size, count = w.end - w.start, w.counts().astype(float)
    per = lambda mask, rows=w.row: np.bincount(rows[mask], minlength=n).astype(float)
    hashes = w.hashes(LOWER)
    weight, strong = lexicon.score(w.codes(LOWER), hashes, size)
    insult = _within(INSULT_WORDS, hashes)
    hits = np.flatnonzero(strong | insult)
    second = np.flatnonzero(_within(SECOND_WORDS, hashes))
    near = np.zeros(len(hits), bool)
    if len(second) and len(hits):
        place = np.searchsorted(second, hits)
        for step in (-1, 0):
            other = second[np.clip(place + step, 0, len(second) - 1)]
            near |= (np.abs(other - hits) <= NEAR) & (w.row[other] == w.row[hits])
    kind = np.zeros(256, np.int8)
    kind[65:91] = 1
    kind[33], kind[63] = 2, 2
    kind[48:58] = 4
    marks = kind[text]
    signs = np.zeros(256, bool)
    signs[[ord(c) for c in LEET]] = True
    # Words of letters and signs for letters, found in the lexicon only if so read.
    obfuscated = np.zeros(n)
    if signs[text].any():
        apart = PUNCTUATION & ~signs
        folded = Words(text, at, apart)
        sign_at = np.concatenate([[0], np.cumsum(signs[text])])
        mixed = np.flatnonzero((sign_at[folded.end] > sign_at[folded.start]) & (sign_at[folded.end] - sign_at[folded.start] < folded.end - folded.start))
        if len(mixed):
            folded.start, folded.end, folded.row = folded.start[mixed], folded.end[mixed], folded.row[mixed]
            h, s = folded.hashes(FOLDED), folded.end - folded.start
            hit = (lexicon.score(folded.codes(FOLDED), h, s)[1] & (s >= 4)) | _within(INSULT_WORDS, h)
            obfuscated = np.bincount(folded.row[hit], minlength=n).astype(float)
    single = size == 1
    run = single.copy()
    for k in (1, 2, 3):
        run[k:] &= single[:-k] & (w.row[k:] == w.row[:-k])
        run[:k] = False
    chars = np.maximum(np.diff(at), 1).astype(float)
    rows_of = np.repeat(np.arange(n), np.diff(at))
    rate = lambda mask: np.bincount(rows_of[mask], minlength=n) / chars
    words = np.maximum(count, 1)
    n_strong, n_insult = per(strong), per(insult)
    total = np.bincount(w.row, weights=weight, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, w.row, weight)
    return np.stack([
        np.log1p(count), n_strong, n_strong / words, per((weight > 0) & ~strong) / words, n_insult, n_insult / words, most, total / np.sqrt(words),
        np.bincount(w.row[hits[near]], minlength=n), rate(marks == 1), rate(marks == 2), rate(PUNCTUATION[text]), rate(marks == 4), obfuscated, per(run),
    ], axis=1)


def by_block(df: DataFrame, extra: list[T.StructField], per_block, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of df (all, if none are named) as they are, and those that per_block makes of each block of texts."""
    where = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if keep is None or c in keep]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, None)
        for batch in batches:
            data, at = column_bytes(batch.column(where))
            parts = [per_block(t, a) for t, a, _ in blocks(data, at)]
            made = np.concatenate(parts) if parts else np.zeros((0, len(extra)))
            columns = [*[batch.column(i) for i in kept], *[pa.array(made[:, i]) for i in range(len(extra))]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def with_features(df: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, prefix: str = "_f_") -> DataFrame:
    # The lexicon is made of a bounded sample, so it is bounded as well.
    shared = df.sparkSession.sparkContext.broadcast((lexicon.keys, lexicon.weights, lexicon.strong))
    made: list = []

    def per_block(text, at):
        if not made:
            made.append(Lexicon(*shared.value))
        return features(text, at, made[0])

    return by_block(df, [T.StructField(f"{prefix}{f}", T.DoubleType()) for f in FEATURES], per_block, keep)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings of words of the labelled sample (text, label) whose documents are toxic beyond chance.

    The measure is the log-likelihood ratio against the overall share; a beginning is strong if the ratio also clears what
    the largest of all beginnings could reach by chance.
    """
    schema = "key long, toxic long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column(0))
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            for text, offsets, row in blocks(data, at):
                w = Words(text, offsets, PUNCTUATION)
                codes, size = w.codes(LOWER), w.end - w.start
                keys, rows = [], []
                for which, key in word_keys(codes, w.hashes(LOWER), size):
                    keys.append(key)
                    rows.append(w.row[which])
                k, r = np.concatenate(keys), np.concatenate(rows)
                order = np.lexsort((r, k))
                k, r = k[order], r[order]
                first = np.ones(len(k), bool)
                first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                k, r = k[first], r[first]
                u, begin = np.unique(k, return_index=True)
                ends = np.append(begin[1:], len(k))
                toxic = np.concatenate([[0], np.cumsum(label[row + r])])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic[ends] - toxic[begin]), pa.array(ends - begin)], names=["key", "toxic", "n"])

    total = sample.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    share = (total["t"] or 0) / total["n"] if total["n"] else 0.0
    none = Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    if not 0 < share < 1:
        return none
    keys = sample.select("text", "label").mapInArrow(count, schema).groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("n").alias("n")).filter("n >= 3")
    p, q = F.col("t") / F.col("n"), F.lit(share)
    part = lambda k, a, b: F.when(k > 0, k * F.log(a / b)).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), p, q) + part(F.col("n") - F.col("t"), 1 - p, 1 - q))
    listed = keys.withColumn("ratio", ratio).filter((p > 2 * q) & (p > 0.4) & (F.col("ratio") > 8)).collect()
    if not listed:
        return none
    bar = 2 * np.log(max(keys.count(), 2)) + 2
    weight = np.array([np.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - np.log(share / (1 - share)) for r in listed])
    strong = np.array([r["ratio"] > bar and r["t"] / r["n"] > 0.8 for r in listed])
    return Lexicon(np.array([r["key"] for r in listed], np.int64).view(np.uint64), weight, strong)


class Toxicity:
    def __init__(self, lexicon: Lexicon, model: gbt.Model, knots: list[tuple[float, float]]):
        self.lexicon, self.model, self.knots = lexicon, model, knots

    def scored(self, docs: DataFrame, name: str = "_toxic", keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` of docs (all, if none are named) with ``name``: the probability of being toxic."""
        keep = [c for c in (docs.columns if keep is None else keep) if c != name]
        prefix = fresh("_f_", [name, *docs.columns])
        d = with_features(docs, self.lexicon, keep, prefix)
        margin = fresh("_margin", d.columns)
        d = d.withColumn(margin, self.model.margin([prefix + f for f in FEATURES]))
        return d.select(*[F.col(f"`{c}`") for c in keep], gbt.calibrated(F.col(margin), self.knots).alias(name))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, training: Column, rows: int) -> DataFrame:
    """doc_id, text and label of at most about ``rows`` labelled training documents, which are sampled before the join. Rows
    that repeat a doc_id count once."""
    labels = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & training)
    chosen = gbt.bounded_sample(labels, "doc_id", {"label": F.max(column).cast("int")}, rows, "labels")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``rows`` rows of two numbers
    return materialize(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Toxicity:
    sample = labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id")), fit_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2 * FOLDS))
    lexicon = learn_lexicon(sample.filter(part < FOLDS))
    rest = materialize(with_features(sample.filter(part >= FOLDS), lexicon, ["doc_id", "label"]), "toxic-features")
    names = [f"_f_{f}" for f in FEATURES]
    return Toxicity(lexicon, *gbt.fit_calibrated(rest, names, "label", part, rounds=20, depth=3))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = model.scored(docs, "score", ["doc_id"])
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


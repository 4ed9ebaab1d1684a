"""Quality rules by weak supervision: rules vote good, vote bad or abstain; expectation-maximisation over the counts of
vote patterns, with a prior, estimates how reliable each is; a document's posterior probability of being good decides.

All of it is DataFrame code. The pattern table has at most 3 ** len(RULES) rows, whatever the corpus, and is fitted on all
documents.

Windows of words count as equal by a 64-bit hash. Defined cases: a null or blank text has no words, all its counts are 0, it
fails the base and is not kept. Repeated rows are judged one by one and alike. A very long text is counted whole, in about
100 bytes of memory for each of its words. An empty table gives no rows. Other columns are passed on by judge() untouched, whatever
their names (all that is computed stands in one struct column whose name the caller chooses).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.stage import materialize

WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 8
VOTES = (1, 0, -1)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in words."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def among(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, places))

    def doubled(h: Column, step: int) -> Column:
        """Hashes of runs twice as long as those of h, which have ``step`` words."""
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    # Each word is hashed once; hashes of 1, 2, 4 and 8 words follow from each other.
    pairs = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))
    windows = let(let(pairs, lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, among))


def _doubled(words: Column) -> Column:
    """Words equal to the word before."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: a == b)
    return F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(pairs, lambda x: x)))


def text_stats(text: Column) -> Column:
    """One struct of counts of a whole text."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(_repeat_words(words)).alias("n_repeat_words"),
            long(_doubled(words)).alias("n_doubled"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANK))
    return F.struct(
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.length(F.regexp_replace(text, r"[^.!?]+", ""))).alias("n_stops"),
        long(F.length(F.regexp_replace(text, r"[^0-9]+", ""))).alias("n_digits"),
    )


#: name, SQL of a vote for bad, SQL of a vote for good; n_words of 0 never comes here (the base fails it first). One rule for
#: each thing measured, for the model takes their votes as independent of each other among good and among bad documents.
RULES = [
    ("symbols", "n_symbols > 0.10 * n_words", "n_symbols <= 0.03 * n_words"),
    ("doubled", "n_doubled > 0.15 * n_words", "n_doubled <= 0.05 * n_words"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words", "word_chars BETWEEN 3 * n_words AND 11 * n_words"),
    ("lines", "10 * n_dup_lines > 5 * n_lines", "10 * n_dup_lines <= 2 * n_lines"),
    ("stops", "n_stops = 0 AND n_words >= 30", "50 * n_stops >= n_words AND 3 * n_stops <= n_words"),
    ("digits", "n_digits > 0.2 * word_chars", "n_digits <= 0.08 * word_chars"),
]
#: What is held of a rule before any document is seen: how often it votes good, bad or abstains on good (1) and on bad (0)
#: documents. A bad document is bad in one respect, as a rule, and passes the other rules.
PRIOR = {1: {1: 0.94, 0: 0.001, -1: 0.059}, 0: {1: 0.6, 0: 0.25, -1: 0.15}}
PRIOR_GOOD = 0.9
#: The prior weighs as much as this share of all documents, so that the model is alike at every size.
STRENGTH = 0.05
#: A rule votes bad on at most this share of good documents, whatever the counts say. One rule alone could not be told from
#: a whole class of its own otherwise.
FALSE_ALARMS = 0.002


def base_failed(s: str = "") -> Column:
    return F.expr(f"({s}n_words < 20 OR 100 * {s}n_repeat_words > 30 * {s}n_words)")


def votes(stats: str) -> list[Column]:
    """1 for good, 0 for bad, -1 for abstaining, by rule; ``stats`` names a struct column."""

    def inside(sql: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", rf"`{stats}`.\1", sql)

    return [F.expr(f"CASE WHEN {inside(bad)} THEN 0 WHEN {inside(good)} THEN 1 ELSE -1 END") for _, bad, good in RULES]


def measure(docs: DataFrame, stats: str = "_quality") -> DataFrame:
    """docs with the struct column ``stats``: the counts."""
    d = docs.withColumn(stats, text_stats(F.col("text")))
    flat = F.struct(
        *[F.col(f"{stats}.w.{n}").alias(n) for n in ("n_words", "word_chars", "n_repeat_words", "n_doubled")],
        *[F.col(f"{stats}.l.{n}").alias(n) for n in ("n_lines", "n_dup_lines")],
        *[F.col(f"{stats}.{n}").alias(n) for n in ("n_symbols", "n_stops", "n_digits")],
    )
    return d.withColumn(stats, flat)


class LabelModel:
    """Share of good documents and vote probabilities, from expectation-maximisation over counted vote patterns.

    The E-step takes the likelihood of all votes, abstentions included; the M-step the counts and the prior, and keeps a
    rule's false alarms under their bound. Each round raises the posterior density; ``heights`` has its logarithms."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], float]], rounds: int = 500):
        k, total = len(RULES), sum(n for _, n in patterns)
        self.share, self.p = PRIOR_GOOD, [{c: dict(PRIOR[c]) for c in (0, 1)} for _ in range(k)]
        self.heights: list[float] = []
        weight = STRENGTH * total
        for _ in range(rounds if total else 0):
            good, height = weight * PRIOR_GOOD, self._prior_height(weight)
            mass = [{c: {v: weight * PRIOR[c][v] for v in VOTES} for c in (0, 1)} for _ in range(k)]
            for pattern, n in patterns:
                q = 1 / (1 + math.exp(-self.logit(pattern)))
                height += n * math.log(sum(self._joint(pattern, c) for c in (0, 1)))
                good += n * q
                for j, v in enumerate(pattern):
                    mass[j][1][v] += n * q
                    mass[j][0][v] += n * (1 - q)
            if self.heights and height - self.heights[-1] < 1e-9 * total:
                break
            self.heights.append(height)
            self.share = good / (total + weight)
            self.p = [{c: {v: m[c][v] / sum(m[c].values()) for v in VOTES} for c in (0, 1)} for m in mass]
            for p in self.p:
                if p[1][0] > FALSE_ALARMS:
                    rest = (1 - FALSE_ALARMS) / (1 - p[1][0])
                    p[1] = {1: p[1][1] * rest, 0: FALSE_ALARMS, -1: p[1][-1] * rest}

    def _joint(self, pattern: tuple[int, ...], c: int) -> float:
        return (self.share if c else 1 - self.share) * math.prod(self.p[j][c][v] for j, v in enumerate(pattern))

    def _prior_height(self, weight: float) -> float:
        share = PRIOR_GOOD * math.log(self.share) + (1 - PRIOR_GOOD) * math.log(1 - self.share)
        return weight * (share + sum(PRIOR[c][v] * math.log(p[c][v]) for p in self.p for c in (0, 1) for v in VOTES))

    def weight(self, j: int, vote: int) -> float:
        """Log odds of good that a rule's vote adds."""
        return math.log(self.p[j][1][vote] / self.p[j][0][vote])

    def logit(self, pattern: tuple[int, ...]) -> float:
        return math.log(self.share / (1 - self.share)) + sum(self.weight(j, v) for j, v in enumerate(pattern))

    def posterior(self, stats: str) -> Column:
        """Probability that a document is good, as an expression."""
        z = F.lit(math.log(self.share / (1 - self.share)))
        for j, v in enumerate(votes(stats)):
            z = z + F.when(v == 1, self.weight(j, 1)).when(v == 0, self.weight(j, 0)).otherwise(self.weight(j, -1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(measured: DataFrame, stats: str = "_quality") -> LabelModel:
    """The label model of all measured documents that pass the base."""
    names = [f"_v{i}" for i in range(len(RULES))]
    rows = measured.filter(~base_failed(f"{stats}.")).select(*[v.alias(n) for v, n in zip(votes(stats), names, strict=True)]).groupBy(*names).count().collect()
    return LabelModel(sorted((tuple(r[:-1]), float(r[-1])) for r in rows))


def judge(docs: DataFrame, stats: str = "_quality") -> DataFrame:
    """docs with ``stats``: the counts, base_failed, p_good and kept. A column of docs that has this name is replaced. The rows
    are written once, for to write a text takes a twentieth of the time that it takes to measure it again."""
    measured = materialize(measure(docs, stats), "quality")
    model = fit(measured, stats)
    more = F.col(stats).withField("base_failed", base_failed(f"{stats}.")).withField("p_good", model.posterior(stats))
    out = measured.withColumn(stats, more)
    return out.withColumn(stats, F.col(stats).withField("kept", ~F.col(f"{stats}.base_failed") & (F.col(f"{stats}.p_good") >= 0.5)))


def op8(spark, sf_dir: str) -> DataFrame:
    s = "_quality"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    measured = materialize(measure(docs, s).drop("text"), "quality-counts")
    model = fit(measured, s)
    p = model.posterior(s)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", *[F.col(f"{s}.{n}").alias(n) for n in names], base_failed(f"{s}.").alias("base_failed"), (~base_failed(f"{s}.") & (p >= 0.5)).alias("kept"), p.alias("p_good"))

"""URL filter: longest-prefix allow/block rules, and boosted trees on lexical features for every other url.

Everything here is DataFrame or SQL code. Labelled urls are those that a rule decides (or any table with url and blocked);
the trees learn from a hash sample of them and give the verdict where no rule fits.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is scored like any other url.
Equal urls get equal verdicts, very long ones count whole. An empty table gives no rows. Without labelled urls of both kinds
the model is a constant: 1 if all are blocked, else 0. Other columns pass through untouched, whatever their names, but for
one named as the struct column that the caller chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import gbt
from factloom.plans.stage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict); a rule is a host followed by the start of a path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Labelled urls that the trees see at most, in expectation: a documented bound of the fit, not of the rows judged.
FIT_ROWS = 12_000
#: Folds for shares out of fold; urls that a key needs for a share of its own; urls of the overall share that each key gets.
FOLDS, LEAST, SMOOTHING = 4, 5, 5


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return (
        df.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def match_rules(df: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Adds rule and rule_verdict: those of the longest rule whose host and subdomains and path prefix fit, else null."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return df.withColumn("rule", found).withColumn("rule_verdict", verdict)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of text, from the counts of 38 classes (letters, digits, dot, rest)."""
    classes = F.translate(text, UPPER, LOWER)
    size = F.greatest(F.length(classes), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz.-/":
        p = (F.length(classes) - F.length(F.replace(classes, F.lit(c), F.lit("")))) / size
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    digits = F.length(F.regexp_replace(classes, "[^0-9]+", "")) / size
    return total - F.when(digits > 0, digits * F.log2(digits)).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> tuple[DataFrame, list[str]]:
    """Adds the dense features of split_url()'s rows. Suffix statistics come from suffix_stats()."""
    u = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(u), F.lit(1)).cast("double")
    cols = {
        "f_len": F.length(u).cast("double"),
        "f_host_len": F.length("host").cast("double"),
        "f_path_len": F.length("path").cast("double"),
        "f_depth": (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"),
        "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_digits": F.length(F.regexp_replace(u, "[^0-9]+", "")) / size,
        "f_hyphens": F.length(F.regexp_replace(u, "[^-_]+", "")) / size,
        "f_params": F.length(F.regexp_replace(u, "[^=]+", "")).cast("double"),
        "f_fragment": F.when(F.instr(u, "#") > 0, 1.0).otherwise(0.0),
        "f_secure": F.when(u.startswith("https"), 1.0).otherwise(0.0),
        "f_entropy": _entropy(u),
    }
    return df.withColumns(cols), [*cols, "f_suffix", "f_section"]


def _suffix() -> Column:
    return F.regexp_extract("host", r"[^.]*$", 0)


def _section() -> Column:
    return F.concat_ws("/", _suffix(), F.regexp_extract("path", r"^/([^/]*)", 1))


def shares(labelled: DataFrame, key: Column, fold: Column) -> DataFrame:
    """key, fold and share: the smoothed share of blocked urls by key, out of fold (over the other folds than ``fold``) and
    over all (fold null). Keys with fewer than LEAST urls are left to the overall share."""
    parts = labelled.groupBy(key.alias("key"), fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    parts = materialize(parts, "url-shares")
    total = parts.groupBy("key").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb")).filter(F.col("tn") >= LEAST)
    every = parts.agg(F.sum("b") / F.sum("n")).first()[0] or 0.0
    smooth = lambda b, n: (b + SMOOTHING * F.lit(float(every))) / (n + SMOOTHING)
    folds = total.select("key", "tn", "tb", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)])).alias("fold"))
    out = folds.join(parts, ["key", "fold"], "left").select("key", "fold", smooth(F.col("tb") - F.coalesce("b", F.lit(0)), F.col("tn") - F.coalesce("n", F.lit(0))).alias("share"))
    whole = total.select("key", F.lit(None).cast("int").alias("fold"), smooth(F.col("tb"), F.col("tn")).alias("share"))
    out = materialize(out.union(whole), "url-shares")
    out.overall = float(every)
    return out


def _with_share(df: DataFrame, key: Column, table: DataFrame, name: str, fold: Column | None = None) -> DataFrame:
    """df with the share of its key, that of its fold where one is given. The table has at most FIT_ROWS / LEAST keys."""
    if fold is None:
        small = table.filter("fold IS NULL").select(F.col("key").alias("_key"), F.col("share").alias(name))
        on = key == F.col("_key")
    else:
        small = table.filter("fold IS NOT NULL").select(F.col("key").alias("_key"), F.col("fold").alias("_of"), F.col("share").alias(name))
        on = (key == F.col("_key")) & (fold == F.col("_of"))
    return df.join(F.broadcast(small), on, "left").withColumn(name, F.coalesce(name, F.lit(table.overall))).drop("_key", "_of")


class UrlFilter:
    """Fitted filter: rules first, trees for the rest."""

    def __init__(self, rules, suffixes, sections, model):
        self.rules, self.suffixes, self.sections, self.model = rules, suffixes, sections, model

    def features(self, df: DataFrame, url: str = "url", fold: Column | None = None) -> tuple[DataFrame, list[str]]:
        df, names = lexical(df, url)
        df = _with_share(df, _suffix(), self.suffixes, "f_suffix", fold)
        return _with_share(df, _section(), self.sections, "f_section", fold), names

    def apply(self, pages: DataFrame, url: str = "url", name: str = "url_filter") -> DataFrame:
        """pages with the struct column ``name``: host, path, rule, block_score (0 to 1) and verdict (allow or block). A column
        of pages that has this name is replaced; all others stay, whatever their names."""
        kept = [c for c in pages.columns if c != name]
        alone = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{url}`").alias("url"))
        df, names = self.features(match_rules(split_url(alone), self.rules))
        score = gbt.probability(self.model.margin(names))
        verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict")
        made = F.struct("host", "path", "rule", F.col("score").alias("block_score"), verdict)
        return df.withColumn("score", score).select("row.*", made.alias(name))


def fit(labelled: DataFrame, rules=RULES, url: str = "url", fit_rows: int = FIT_ROWS, rounds: int = 10, depth: int = 3) -> UrlFilter:
    """labelled: url and blocked (0 or 1). Learns from a hash sample of about fit_rows of its distinct urls at most; of a url
    with both labels the larger counts. The shares that the trees see are out of fold: a url never adds to its own, nor
    does any url of its host."""
    labelled = labelled.select(F.col(f"`{url}`").alias("url"), F.col("blocked").cast("int").alias("blocked"))
    sample = gbt.bounded_sample(labelled.filter("url IS NOT NULL"), "url", {"blocked": F.max("blocked")}, fit_rows, "url-fit")
    sample = split_url(sample)
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    first = UrlFilter(rules, shares(sample, _suffix(), fold), shares(sample, _section(), fold), None)
    df, names = first.features(sample, fold=fold)
    first.model = gbt.fit(df.select(*names, F.col("blocked").alias("label")), names, "label", rounds=rounds, depth=depth)
    return first


def labelled_by_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """The urls that a rule decides, as training labels."""
    known = match_rules(split_url(pages.select(F.col(f"`{url}`").alias("url"))), rules).filter("rule_verdict IS NOT NULL")
    return known.select("url", (F.col("rule_verdict") == "block").cast("int").alias("blocked"))


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = fit(labelled_by_rules(pages))
    return model.apply(pages).select("page_id", "url_filter.*")

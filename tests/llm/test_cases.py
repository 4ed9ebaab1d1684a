"""Odd input: clashing names, repeats, large numbers, damaged files; and the operators against brute force."""

import io
import math

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SF, docs

from factloom.llm import bpe, gbt, mixing, near_dup, quality_knn, quality_rules, token_count, topk, toxicity, urlfilter, warc
from factloom.llm.textvec import fresh


def clashing(spark, texts):
    """Documents with columns named like anything that operators make for themselves."""
    names = "row size key target whole extra taken _range _spans _offset ids decoded n_tokens n_bytes _margin _f_words _f_ _toxic _quality _own _copy host path rule verdict f_len _key label v fold"
    return docs(spark, texts).select("*", *[F.lit("KEEP").alias(n) for n in names.split()])


def test_columns_with_clashing_names_stay(spark):
    d = clashing(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    model, space = toxicity.fit(d, labels), quality_knn.fit(d, labels)
    urls = d.withColumn("url", F.lit("http://a.com/fr/"))
    outs = [
        mixing.mixture(d), bpe.encoded(d), token_count.counted(d), model.scored(d, "s"), quality_knn.scored(d, space, "s"), quality_rules.judge(d, "q"),
        urlfilter.fit(urlfilter.labelled_by_rules(urls)).apply(urls), mixing.plan(d.withColumn("size", F.lit(1)).withColumn("key", F.md5(F.col("text").cast("binary"))), ["doc_id"]),
    ]
    made = {"size", "key", "target", "whole", "extra", "taken"}
    for i, out in enumerate(outs):
        kept = [c for c in d.columns if c not in ("doc_id", "source", "text", *(made if i == len(outs) - 1 else ()))]
        assert out.count() and out.filter(" OR ".join(f"`{c}` <> 'KEEP'" for c in kept)).isEmpty(), i
    assert bpe.digests(bpe.encoded(d)).count() == len(ODD)
    assert fresh("_a", ["_A", "_ab"]) == "_a_"


@pytest.mark.parametrize("index", range(5))
def test_stages_take_clashing_names_nulls_and_empty_tables(spark, index):
    name, stage = corpus_pipeline.STAGES[index]
    d = clashing(spark, [*ODD, " ".join(f"word{i}" for i in range(40)) + "."])
    for rows in (d, d.filter("false")):
        out = corpus_pipeline.materialize(stage(spark, rows, SF), "test")
        assert name == "bpe" or out.columns == d.columns
        assert name == "bpe" or out.filter("_toxic <> 'KEEP' OR _quality <> 'KEEP'").isEmpty()
    assert out.count() == 0


def test_rows_that_share_a_doc_id_stay_but_for_equal_ones(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "a"), (1, words, "b"), (1, "other " * 9, "a"), (2, words, "a"), (3, "third text of its own", "a"), (None, words, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [{tuple(r) for r in corpus_pipeline.distinct(spark, d, SF).collect()} for _ in range(2)]
    assert got[0] == got[1] and sorted((i or 0, t) for i, t, _ in got[0]) == sorted([(0, words), (1, words), (1, "other " * 9), (3, "third text of its own")])


# --- top-k


def test_large_components_and_sums(spark):
    big = 2**22
    rows = [(0, [big] * 64), (1, [big] * 64), (2, [2**31, 2**31, -(2**31)]), (3, [2**31, 2**31, 2**31]), (4, [-(2**62)]), (5, [2**40, -(2**40), 1]), (6, []), (8, [2**63 - 1, 1])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "id long, q array<long>"), F.lit(True), k=9).collect()]
    want = []
    for q, v in rows:
        clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
        s = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in rows if i != q)
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    assert sorted(got) == sorted(want)
    wide = topk.quantised(spark.createDataFrame([(1, [1e300, -1e300, 1e8])], "vec_id long, embedding array<double>")).first()["q"]
    assert wide == [2**63 - 1, -(2**63 - 1), 25_600_000_000]


def test_query_rows_that_share_an_id_are_separate_queries(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (0, [0, 1]), *[(i, [i, -i]) for i in range(1, 9)]]
    got = topk.top_k(spark.createDataFrame(rows, "id long, q array<long>").withColumn("extra", F.lit(1)), F.col("id") == 0)
    assert [(r["score"], r["n"]) for r in got.groupBy("score").agg(F.count("*").alias("n")).orderBy("score").collect()] == [(-5, 2), (-4, 2), (-3, 2), (-2, 2), (-1, 2), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1)]
    assert topk.top_k(spark.createDataFrame([], "id long, q array<long>"), F.lit(True)).count() == 0


# --- token counts, WARC


def test_segments_of_no_length_and_nul(spark):
    texts = ["a\0b a\0b a\0b x", "\0", " \n ", "a  a  a"] * 3
    with open(token_count.vocabulary_file(), "rb") as f:
        library = token_count.Lengths(f.read()).library
    got = {r["doc_id"]: r["tokens"]["n_tokens"] for r in token_count.counted(docs(spark, texts)).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    assert token_count.counted(docs(spark, texts).filter("false")).count() == 0


def test_vocabularies_that_span_words_count_whole_texts():
    with open(token_count.vocabulary_file(), "rb") as f:
        lengths = token_count.Lengths(f.read())
    assert lengths.by_segments
    lengths.by_segments = False
    assert lengths.count_block(["a b\nc", ""]) == [len(lengths.library.encode("a b\nc")), 0]


def test_damaged_members_are_told(spark, tmp_path):
    good = warc.record(1, None, b"a" * 5000, "D", None)
    cut = warc.record(2, "u", np.random.default_rng(0).bytes(5000), "D", None)[:-2000]
    number = warc.zlib.compressobj(4, warc.zlib.DEFLATED, 31)
    broken = number.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n") + number.flush()
    (tmp_path / "a.gz").write_bytes(good + broken + good + cut)
    size = (tmp_path / "a.gz").stat().st_size
    files = spark.createDataFrame([(f"file://{tmp_path}/a.gz", size)], "file string, size long")
    got = [(r["page_id"], r["url"], r["record_type"], r["payload_bytes"]) for r in warc.read_archive(spark, files).collect()]
    assert got == [(1, None, "response", 0), (None, None, "damaged", None), (1, None, "response", 0), (2, "u", "damaged", None)] or [g[2] for g in got] == ["response", "damaged", "response", "damaged"]
    assert [h["warc-record-id"] for h, _ in warc.read_range(io.BytesIO(good + good), 0, 10**6, 2 * len(good))] == ["<urn:page:1>"] * 2


# --- samples, URL filter


def test_a_hot_key_counts_once_in_a_sample(spark):
    rows = spark.createDataFrame([(f"u{i}" if i % 4 else "hot", i % 2) for i in range(8000)], "url string, blocked int")
    n = gbt.bounded_sample(rows, "url", {"blocked": F.max("blocked")}, 1000, "test").agg(F.count("*").alias("n"), F.count_distinct("url").alias("d")).first()
    assert 850 < n["n"] < 1150 and n["n"] == n["d"]


def test_urls_of_hosts_that_were_never_seen(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(300):
        bad = h % 2
        host = f"h{h}.test" if not bad else f"{rng.integers(10**6)}-{h}.test"
        rows += [(f"http://{host}/{'a/' * int(rng.integers(1, 3))}{'?x=1&y=2' if bad and rng.random() < 0.7 else ''}", bad) for _ in range(3)]
    train, held = rows[:600], rows[600:]
    model = urlfilter.fit(spark.createDataFrame(train, "url string, blocked int"), rules=[])
    out = model.apply(spark.createDataFrame(held, "url string, blocked int")).select("url_filter.block_score", "blocked").collect()
    good, bad = ([r[0] for r in out if r[1] == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


def test_trees_as_sql_equal_trees_in_python(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    model = gbt.fit(df, ["a", "b", "c"], "y")

    def value(t, r):
        return t.value if t.feature < 0 else value(t.high if r[t.feature] > t.cut else t.low, r)

    got = [r[0] for r in df.select(model.margin(["a", "b", "c"])).collect()]
    assert got == pytest.approx([model.prior + sum(value(t, r) for t in model.trees) for r in x])
    _, knots = gbt.fit_calibrated(df, ["a", "b", "c"], "y", F.pmod(F.xxhash64("a"), F.lit(3)))
    assert all(a < b and p <= q for (a, p), (b, q) in zip(knots, knots[1:], strict=False))
    scores = sorted((m, r[0]) for m, r in zip(got, df.select(gbt.calibrated(model.margin(["a", "b", "c"]), knots)).collect(), strict=True))
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(scores, scores[1:], strict=False))


# --- classifiers against brute force


def test_toxicity_features_equal_a_plain_scan():
    text = "You IDIOT, you are s-t-u-p-i-d! st*pid m0ron disgustingly disgusting a b c d 12"
    data, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    f = dict(zip(toxicity.FEATURES, toxicity.features(data, at, toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)))[0], strict=True))
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    insults = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    seconds = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    assert f["words"] == pytest.approx(math.log1p(len(words))) and f["insults"] == len(insults) == 2  # "disgustingly" is another word
    assert f["near_second"] == sum(any(abs(i - j) <= toxicity.NEAR for j in seconds) for i in insults)
    assert f["capitals"] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and f["digits"] == pytest.approx(sum(c.isdigit() for c in text) / len(text))
    assert f["obfuscated"] == 1 and f["punctuation"] == pytest.approx(sum(not c.isalnum() for c in text) / len(text))


def test_votes_equal_a_plain_search(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:120] + ["", None]
    labels = spark.createDataFrame([(i, (i // 3) % 2) for i in range(80)], "doc_id long, quality int")
    d = docs(spark, texts)
    space = quality_knn.fit(d, labels)
    got = {r["doc_id"]: r["s"] for r in quality_knn.scored(d, space, "s", ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        v = space.project(quality_knn.counts(raw, np.array([0, len(raw)])))[0]
        if not v.any():
            assert got[i] == pytest.approx(space.labels.mean())
            continue
        near = sorted(((sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), y) for w, y in zip(space.vectors, space.labels, strict=True)), reverse=True)
        near = [x for x in near if x[0] >= near[min(len(near), quality_knn.NEIGHBOURS) - 1][0] - quality_knn.TIE]
        weights = [math.exp(quality_knn.SHARPNESS * c) for c, _ in near]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights), abs=1e-3)


def test_label_model_climbs_and_finds_a_planted_class(spark):
    rng = np.random.default_rng(4)
    rows: dict = {}
    for _ in range(20_000):
        bad = rng.random() < 0.1
        fails = int(rng.integers(len(quality_rules.RULES))) if bad else -1
        votes = tuple(0 if j == fails else -1 if rng.random() < 0.05 else 0 if rng.random() < 0.0005 else 1 for j in range(len(quality_rules.RULES)))
        n = rows.setdefault(votes, [0, 0])
        n[bad] += 1
    model = quality_rules.LabelModel([(v, float(sum(n))) for v, n in sorted(rows.items())])
    assert len(model.heights) > 1 and all(b >= a for a, b in zip(model.heights, model.heights[1:], strict=False))
    kept = {v: model.logit(v) >= 0 for v in rows}
    assert sum(n[0] for v, n in rows.items() if kept[v]) > 0.98 * sum(n[0] for n in rows.values())
    assert sum(n[1] for v, n in rows.items() if not kept[v]) > 0.95 * sum(n[1] for n in rows.values())
    small = quality_rules.LabelModel([(v, sum(n) / 100) for v, n in sorted(rows.items())])
    assert {v: small.logit(v) >= 0 for v in rows} == kept  # alike at every size


def test_kept_follows_the_posterior_of_plain_counts(spark):
    sf = "/root/testdata/sf0.01"
    measured = quality_rules.measure(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).select("doc_id", "_quality.*").collect()
    patterns: dict = {}
    of = {}
    for r in measured:
        if r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]:
            continue
        names = {k: r[k] for k in r.asDict()}
        vote = lambda sql, names=names: eval(sql.replace("OR", "or").replace("AND", "and").replace(" = ", " == ").replace("word_chars BETWEEN 3 * n_words and 11 * n_words", "3 * n_words <= word_chars <= 11 * n_words"), {}, names)  # noqa: E731, S307
        of[r["doc_id"]] = p = tuple(0 if vote(bad) else 1 if vote(good) else -1 for _, bad, good in quality_rules.RULES)
        patterns[p] = patterns.get(p, 0.0) + 1
    model = quality_rules.LabelModel(sorted(patterns.items()))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.op8(spark, sf).collect()}
    assert {i for i, k in got.items() if k} == {i for i, p in of.items() if model.logit(p) >= 0}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ([got[i] for i, q in labels.items() if q == v and i in got] for v in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


# --- BPE joins, near duplicates


def test_joins_that_disagree_send_the_text_to_the_library():
    with open(bpe.vocabulary_file(), encoding="utf-8") as f:
        e = bpe.Encoder(f.read())
    text = b"one two three"
    sides = [[text[:4], text[4:]], [text]]
    assert e.disagreeing(sides) == set()
    e.learn({"two"})
    e.young["two"] = (b"\0\0\0\0", "wrong")
    assert e.disagreeing(sides) == {0}


def test_large_groups_of_equal_and_of_near_equal_documents(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.permutation(300)]
    near = []
    for k in range(400):
        w = list(base)
        for at in rng.choice(300, 1 + k % 3, replace=False):
            w[at] = f"z{k}y{at}"
        near.append(" ".join(w))
    other = " ".join(f"q{i}" for i in rng.permutation(200))
    texts = [" ".join(base), *near, *[other] * 5000]
    got = near_dup.near_duplicates(docs(spark, texts)).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in got) == [(0, 401), (401, 5000)]


def test_least_of_is_the_binomial_bound():
    assert near_dup.least_of(16, 0.8) == 3 and near_dup.least_of(4, 1.0) == 4 and near_dup.least_of(16, 0.01) == 1


def test_keys_too_many_for_a_broadcast_give_the_same_rows(spark, monkeypatch):
    base = [" ".join(f"w{d}x{i}" for i in range(60)) for d in range(6)]
    texts = base + [t + " more" for t in base[:4]] + [base[0], "", None]
    rows = lambda: sorted(map(tuple, near_dup.near_duplicates(docs(spark, texts)).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    want = rows()
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", 0)
    assert rows() == want and sum(not r[3] for r in want) == 5

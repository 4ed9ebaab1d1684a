import hashlib
import io

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, near_dup, quality_knn, quality_rules, token_count, topk, toxicity, urlfilter, warc
from factloom.llm.textvec import Words, blocks, column_bytes, shingles

ODD = [None, "", " ", "\n\n", "  a  b ", "it's I'LL <|endoftext|> x<|startoftext|>", "É ß Σ ὈΔΥΣΣΕΎΣ İ 中文 😀 e\u0301", "▁ a▁b", "a\0b a\0b a\0b x", "don't 4.5% 10²", "w" * 3000, "a \nb\n c", " ".join(f"word{i % 700}" for i in range(6000))]
SF = "/root/testdata/sf0.001"


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, f"s{i % 2}" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- url filter


def test_hosts_paths_and_rules(spark):
    urls = [None, "nothing", "http://A.Example.org/es/x?q", "https://example.org/en/12#f", "x://b.com/de", "x://b.com/de/1", "x://b.com?x", "://ÄB.net/ y", "x://notorg/", "http://org/"]
    got = urlfilter.match_rules(urlfilter.split_url(spark.createDataFrame([(u,) for u in urls], "url string"))).collect()
    assert [(r["host"], r["path"], r["rule"], r["rule_verdict"]) for r in got] == [
        ("", "", None, None), ("", "", None, None), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.com", "/de", None, None),
        ("b.com", "/de/1", "com/de/", "block"), ("b.com", "", None, None), ("Äb.net", "/ y", None, None), ("notorg", "/", None, None), ("org", "/", "org/", "allow"),
    ]


def test_trees_learn_labelled_urls(spark):
    rows = [(f"http://h{i}.test/{'x' * (i % 9)}{'?a=1&b=2' if i % 2 else ''}", i % 2) for i in range(400)]
    model = urlfilter.fit(spark.createDataFrame(rows, "url string, blocked int"), rules=[])
    got = model.apply(spark.createDataFrame(rows, "url string, blocked int")).select((F.col("url_filter.verdict") == "block").cast("int") == F.col("blocked")).collect()
    assert all(r[0] for r in got)
    assert model.apply(spark.createDataFrame([], "url string, host string")).count() == 0


# --- top-k


@pytest.mark.parametrize("dense", [True, False])
def test_top_k_equals_brute_force(spark, dense):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (130, 6)) * (1 if dense else rng.integers(0, 2, (130, 6)))
    rows = [(int(i), [int(v) for v in r]) for i, r in enumerate(x)] + [(7, [1, 1]), (200, [])]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "id long, q array<long>").repartition(3), F.col("id") % 50 == 0).collect()}
    want = set()
    for q, v in rows:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:5]
            want |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(s)}
    assert got == want


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0])]
    got = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(0, [128, -1]), (5, [256, 256])]


# --- mixing


def test_mix_equals_sql_and_targets(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.SQL3)
    got = mixing.op3(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.filter("taken > 2 * size").count() == 0


def test_targets_hand_on_the_excess(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), (None, 5)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    total, weight, cap = 1.5 * sum(n for _, n in sizes), {"a": 3, "b": 1, "c": 2, None: 3}, {s: 2 * n for s, n in sizes}
    want, open_ = {}, set(weight)
    while open_:
        left, w = total - sum(want.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > cap[s]}
        want |= {s: float(cap[s]) for s in over} if over else {s: left * weight[s] / w for s in open_}
        open_ -= over or open_
    assert got == pytest.approx(want)


def test_mixture_cuts_at_the_budget(spark):
    d = docs(spark, ODD).withColumn("size", F.lit("clash"))
    out = mixing.mixture(d)
    assert out.columns == d.columns
    plan = mixing.plan(d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), mixing.random_key(F.col("doc_id"), F.col("text")).alias("key")), ["doc_id", "size"])
    want = {r["doc_id"]: r["taken"] for r in plan.filter("taken > 0").collect()}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words_of(r["text"]))
    assert got == want
    assert mixing.mixture(d.filter("false")).count() == 0


# --- WARC


def test_round_trip_and_splits(spark, tmp_path):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "a" * 70000, "\x1f\x8b\x08 WARC/1.1", "a"])] + [(None, None, "z"), (None, None, "z")]
    df = warc.with_originals(spark.createDataFrame(pages, "page_id long, url string, html string")).repartition(2)
    files = warc.write_archive(df, f"file://{tmp_path}/w")
    for split in (1 << 20, 97):
        got = warc.read_archive(spark, files, split=split, payloads=True).collect()
        assert len(got) == len(pages)
        by = {r["page_id"]: r for r in got if r["page_id"] is not None}
        assert {i: r["refers_to"] for i, r in by.items()} == {0: 7, 1: None, 2: 7, 3: 4, 4: None, 5: None, 6: None, 7: None}
        for i, _, html in pages:
            raw = (html or "").encode()
            if i is not None:
                assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == warc.digest32(raw)
                assert bytes(by[i]["payload"]) == (raw if by[i]["record_type"] == "response" else b"")


def test_magic_inside_a_payload_starts_no_record():
    data = warc.record(1, "u", np.random.default_rng(0).bytes(5000) + warc.MAGIC, "D", None) + warc.record(2, "u", b"", "D", None)
    ids = [h["warc-record-id"] for s in range(0, len(data), 50) for h, _ in warc.read_range(io.BytesIO(data), s, s + 50, len(data))]
    assert ids == ["<urn:page:1>", "<urn:page:2>"]


def test_a_long_url_does_not_hide_its_record():
    url = "http://x/" + np.random.default_rng(1).bytes(1_000_000).hex()
    data = warc.record(1, url, b"a", "D", None) + warc.record(2, "u", b"b", "D", None)
    got = [(h["warc-record-id"], h["warc-target-uri"]) for h, _ in warc.read_range(io.BytesIO(data), 0, len(data), len(data))]
    assert got == [("<urn:page:1>", url), ("<urn:page:2>", "u")]


# --- tokens


def test_bpe_equals_the_library(spark):
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    with open(bpe.vocabulary_file(), encoding="utf-8") as f:
        library = bpe.Encoder(f.read()).library
    got = {r["doc_id"]: r for r in bpe.digests(bpe.encoded(docs(spark, texts), keep=["doc_id"])).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(e)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_counts_equal_the_library(spark):
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    with open(token_count.vocabulary_file(), "rb") as f:
        library = token_count.Lengths(f.read()).library
    got = {r["doc_id"]: r for r in token_count.counted(docs(spark, texts)).collect()}
    assert all(got[i]["tokens"]["n_tokens"] == len(library.encode(t or "")) and got[i]["tokens"]["n_bytes"] == len((t or "").encode()) for i, t in enumerate(texts))


# --- classifiers


@pytest.mark.parametrize("operator, column", [(toxicity.op6, "toxic"), (quality_knn.op7, "quality")])
def test_held_out_rows_are_told_apart(spark, operator, column):
    sf = "/root/testdata/sf0.01"
    out = operator(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", column).collect()
    good, bad = ([r["score"] for r in out if r[column] == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


def test_odd_texts_have_scores(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, ODD).withColumn("label", F.lit("clash"))
    model = toxicity.fit(d, labels)
    assert model.scored(d).filter("_toxic BETWEEN 0 AND 1").count() == len(ODD)
    space = quality_knn.fit(d, labels)
    assert quality_knn.scored(d, space).filter("_good BETWEEN 0 AND 1").count() == len(ODD)
    assert quality_knn.scored(d, quality_knn.fit(d, labels.filter("false"))).filter("_good = 0.5").count() == len(ODD)
    assert toxicity.fit(d, labels.filter("false")).scored(d).filter("_toxic < 0.5").count() == len(ODD)
    assert model.scored(d.filter("false")).count() == 0


# --- quality rules


def brute_stats(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in text or "")


def test_counts_equal_brute_force(spark):
    some = [t for t in ODD if len(t or "") < 4000] + ["a b c d e f g h " * 3, "x " + "a b c d e f g h i\n" * 2, "a\na\n b\nb", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9", "# * | <> %"]
    some += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) < 4000").fetchall()]
    d = docs(spark, some).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r["_quality"] for r in quality_rules.measure(d).collect()}
    assert [tuple(got[i][n] for n in ("n_words", "word_chars", "n_repeat_words", "n_dup_lines", "n_symbols")) for i in range(len(some))] == [brute_stats(t) for t in some]
    judged = quality_rules.judge(d).select("_quality.*").collect()
    assert all(not r["kept"] for r in judged if r["base_failed"]) and quality_rules.judge(d.filter("false")).count() == 0


# --- near duplicates


def brute_groups(texts, percent=85):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [(i, len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)]


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 900, 150)]
    near = []
    for _ in range(40):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            w[at] = f"z{rng.integers(0, 10**6)}"
        near.append(" ".join(w))
    texts = [*ODD, *near, "a b c", "A B  c", "a b c d", near[0].upper(), *[" ".join(base[:60] + [f"q{k}{i}" for i in range(40)]) for k in range(8)]]
    got = near_dup.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_groups(texts)


def test_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (1, "g h i j k l"), (None, "a b c d e f"), (5, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(1, 1, True)] * 3 + [(2, 1, False), (5, 5, True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_few_links_take_one_written_table_and_no_rounds(spark, monkeypatch):
    rng, written = np.random.default_rng(5), []
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(i + 1, i) for i in range(1000, 1200)] + [(7000, 7000)]
    links, real = spark.createDataFrame(pairs, "a long, b long"), near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, name: written.append(name) or real(df, name))
    few = {tuple(r) for r in near_dup.components(links).collect()}
    assert len(written) == 1
    assert near_dup.components(links.limit(0)).isEmpty()
    monkeypatch.setattr(near_dup, "LOCAL_LINKS", 0)
    assert few == {tuple(r) for r in near_dup.components(links).collect()}
    assert {(k, 1000) for k in range(1000, 1201)} <= few


def test_components_run_to_the_end(spark):
    order = np.random.default_rng(2).permutation(300).tolist()
    pairs = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501), (501, 502)], "a long, b long")
    want = {(i, 0) for i in range(300)} | {(i, 500) for i in (500, 501, 502)}
    assert {tuple(r) for r in near_dup.components(pairs).collect()} == want


def test_words_in_blocks_are_words_of_texts():
    texts = ["a bb", "", "bb", "c" * 100, " x ", "bb a"]
    data, at = column_bytes(pa.array(texts))
    whole = Words(data, at)
    assert whole.counts().tolist() == [2, 0, 1, 1, 1, 2]
    h = whole.hashes()
    assert h[1] == h[2] == h[5] and h[0] == h[6] and h[0] != h[1]
    parts = np.concatenate([Words(t, a).hashes() for t, a, _ in blocks(data, at, 7)])
    assert (parts == h).all()
    assert shingles(h, whole.row, 6)[1].tolist() == [0, 2, 3, 4, 5]


# --- SQL


@pytest.mark.parametrize("name", ["op2_exact_top_k", "op4_warc", "op10_near_duplicates"])
def test_queries_equal_their_sql(spark, name):
    from factloom.llm import queries

    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLES[name]).project(", ".join(names)).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())

import corpus_pipeline
import numpy as np
from factloom.llm import bpe, mixing, near_dup, quality_rules
from test_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == names
        if name == "near duplicates":
            assert near_dup.near_duplicates(docs).filter("NOT kept").count() == 0
        if name == "quality rules":
            assert quality_rules.measure(docs).filter(quality_rules.base_failed("_quality.")).count() == 0
        if name == "mix":
            total = before.select(mixing.n_words(before["text"]).alias("n")).groupBy().sum("n").first()[0]
            assert abs(docs.select(mixing.n_words(docs["text"]).alias("n")).groupBy().sum("n").first()[0] - 1.5 * total) <= docs.select("source").distinct().count()
        if name == "bpe":
            want = bpe.digests(bpe.encoded(before, keep=["doc_id"]))
            assert want.exceptAll(docs).isEmpty() and docs.count() == before.count()
    assert counts[0] > counts[1] > counts[3]


def test_near_duplicates_from_four_fifths_on_are_removed(spark):
    rng, texts = np.random.default_rng(5), []
    for k in range(12):
        base = [f"w{k}x{i}" for i in rng.permutation(200)]
        texts.append(" ".join(base))
        # 3, 4 and 5 words far apart: similarity 0.858, 0.815 and 0.774.
        for n in (3, 4, 5)[: 1 + k % 3] if k % 2 else (4,):
            texts.append(" ".join(f"z{k}y{n}y{i}" if i in range(20, 20 + 30 * n, 30) else w for i, w in enumerate(base)))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i for i, _, _, kept in brute_groups(texts, 80) if kept}
    assert want < {i for i, _, _, kept in brute_groups(texts, 85) if kept}
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF).collect()} == want

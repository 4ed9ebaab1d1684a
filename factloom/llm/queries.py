"""The queries of the training-data operators, and their SQL."""

from factloom.llm import bpe, mixing, near_dup, quality_knn, quality_rules, token_count, topk, toxicity, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1,
    "op2_exact_top_k": topk.op2,
    "op3_mix_sources": mixing.op3,
    "op4_warc": warc.op4,
    "op5_bpe": bpe.op5,
    "op6_toxicity": toxicity.op6,
    "op7_quality_classifier": quality_knn.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_token_counts": token_count.op9,
    "op10_near_duplicates": near_dup.op10,
}
ORACLES = {"op2_exact_top_k": topk.SQL2, "op3_mix_sources": mixing.SQL3, "op4_warc": warc.SQL4, "op10_near_duplicates": near_dup.SQL10}

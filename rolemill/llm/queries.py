"""The registered queries of these operators, and their SQL where it can express them."""

from __future__ import annotations

from rolemill.llm import exact_dedup as dedup
from rolemill.llm import exact_topk, fill_in_middle, hard_negatives, jaccard_join, language_id, length_buckets, line_dedup, line_quality, piece_bpe, preference_format, source_mixing, url_graph
from rolemill.llm.common import read


def exact_query(spark, sf_dir: str):
    return dedup.exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_preference_format": preference_format.preference_query,
    "op2_source_mixing": source_mixing.mixing_query,
    "op3_url_graph": url_graph.url_query,
    "op4_language_id": language_id.language_query,
    "op5_jaccard_join": jaccard_join.jaccard_query,
    "op6_exact_dedup": exact_query,
    "op7_line_dedup": line_dedup.line_query,
    "op8_exact_topk": exact_topk.topk_query,
    "op9_length_buckets": length_buckets.packing_query,
    "op10_line_quality": line_quality.quality_query,
    "op11_piece_bpe": piece_bpe.piece_query,
    "op12_hard_negatives": hard_negatives.negatives_query,
    "op13_fill_in_middle": fill_in_middle.fim_query,
}

ORACLES = {
    "op1_preference_format": preference_format.SQL,
    "op2_source_mixing": source_mixing.SQL,
    "op6_exact_dedup": dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_exact_topk": exact_topk.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}

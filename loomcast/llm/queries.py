"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontaminate, jaccard_join, katz_lm, kmer_dedup, line_dedup, mix_sources, quality_gam, spelling, suffix_dedup, topk_search, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_topk_search": topk_search.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_katz_lm": katz_lm.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_url_filter": url_filter.op5,
    "op6_jaccard_join": jaccard_join.op6,
    "op7_quality_gam": quality_gam.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_kmer_dedup": kmer_dedup.op9,
    "op10_mix_sources": mix_sources.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_toxicity": toxicity.op12,
    "op13_spelling_variants": spelling.op13,
}

SQL = {
    "op1_topk_search": topk_search.SQL,
    "op5_url_filter": url_filter.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_mix_sources": mix_sources.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op13_spelling_variants": spelling.SQL,
}

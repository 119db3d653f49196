"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quoin.llm import best_fit, bpe, decontaminate, filter_audit, hard_negatives, html_extract, mpeg_audio, ngram_join, packed_ids, pii, quality, toxicity, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_ids": packed_ids.op7_token_ids,
    "op8_best_fit_packing": best_fit.op8_best_fit_packing,
    "op9_media_columns": mpeg_audio.op9_media_columns,
    "op10_pii": pii.op10_pii,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bpe": bpe.op12_bpe,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE_SQL,
    "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}

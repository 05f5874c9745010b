"""The queries of the ten operators, and SQL texts where SQL can express them."""

from __future__ import annotations

from keyloom.llm import backoff, decontaminate, jaccard_join, langid, mixing, outliers, paragraphs, quality_fm, tokens, toxicity

QUERIES = {
    "op1_language_crf": langid.op1,
    "op2_outlier_rules": outliers.op2,
    "op3_quality_fm": quality_fm.op3,
    "op4_paragraph_dedup": paragraphs.op4,
    "op5_token_ids": tokens.op5,
    "op6_backoff_score": backoff.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_source_mix": mixing.op8,
    "op9_toxicity_grade": toxicity.op9,
    "op10_decontaminate": decontaminate.op10,
}

SQL = {
    "op4_paragraph_dedup": paragraphs.SQL,
    "op6_backoff_score": backoff.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op8_source_mix": mixing.SQL,
    "op10_decontaminate": decontaminate.SQL,
}

"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from codeloom.llm import decontaminate, html, jaccard, lm, pieces, quality, sharding, substring, toxicity, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_rendezvous": sharding.op6_rendezvous,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_pieces": pieces.op8_pieces,
    "op9_html": html.op9_html,
    "op10_lm": lm.op10_lm,
}
SQL = {
    "op1_quality": quality.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op6_rendezvous": sharding.OP6_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
}

"""The queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_extract, mixing, perplexity, prefix_prints, quality, simhash, suffix_dedup, toxicity, warc, wordpiece

QUERIES = {
    "op1_quality_trees": quality.op1_quality_trees,
    "op2_perplexity_rules": perplexity.op2_perplexity_rules,
    "op3_toxicity_restored": toxicity.op3_toxicity_restored,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_token_counts": wordpiece.op7_token_counts,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_html_main_text": html_extract.op10_html_main_text,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_prefix_prints": prefix_prints.op12_prefix_prints,
}

SQL = {
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op6_warc_round_trip": warc.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_html_main_text": html_extract.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}

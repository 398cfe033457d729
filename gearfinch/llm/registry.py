"""The registered queries of this subpackage and their DuckDB SQL."""

from . import decontaminate, line_dedup, merkle, mixing, near_dedup, quality_rules, resampling, secrets, substring_dedup, suffix_dedup, token_counts, url_filters, warc

QUERIES = {
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op6_warc": warc.op6_warc,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op7_url_filters": url_filters.op7_url_filters,
    "op10_token_counts": token_counts.op10_token_counts,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_secret_scan": secrets.op13_secret_scan,
}
ORACLE = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_secret_scan": secrets.OP13_SQL,
}

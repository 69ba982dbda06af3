"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bitplanes, decontamination, fingerprints, jaccard, line_dedup, packing, quality, sharding, token_counts, url_filters

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_token_files": bitplanes.op2_token_files,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_packing": packing.op4_packing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_quality": quality.op9_quality,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}

ORACLE_SQL = {"op3_url_filters": url_filters.OP3_SQL, "op5_line_dedup": line_dedup.OP5_SQL}

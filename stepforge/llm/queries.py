"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from stepforge.llm import ann, decontaminate, fingerprint_log, jaccard_join, license_scan, packing, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        ann.op1_ann_multi_index,
        decontaminate.op2_decontamination,
        license_scan.op3_license_scan,
        token_counts.op4_token_counts,
        packing.op5_best_fit_packing,
        suffix_dedup.op6_suffix_dedup,
        toxicity.op7_toxicity,
        warc.op8_warc_derivatives,
        jaccard_join.op9_jaccard_join,
        fingerprint_log.op10_fingerprint_log,
    )
}
ORACLES = {"op3_license_scan": license_scan.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "op10_fingerprint_log": fingerprint_log.ORACLE}

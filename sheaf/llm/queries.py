"""The queries of this folder and the SQL for those that SQL can express."""

from __future__ import annotations

from . import debruijn, images, latent, licences, packing, pii, quality, sketches, suffixes, url_rules

QUERIES = {
    "op1_url_filter": url_rules.op1_url_filter,
    "op2_media_copies": images.op2_media_copies,
    "op3_pii": pii.op3_pii,
    "op4_license_scan": licences.op4_license_scan,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_quality": quality.op6_quality,
    "op7_minhash_near_dedup": sketches.op7_minhash_near_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_benchmark_decontamination": latent.op9_benchmark_decontamination,
    "op10_substring_dedup": debruijn.op10_substring_dedup,
}

ORACLES = {
    "op1_url_filter": url_rules.ORACLE,
    "op4_license_scan": licences.ORACLE,
}

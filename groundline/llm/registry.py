"""Queries of the training-data operators, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

from groundline.llm import bpe, fingerprint, license, neardup, packing, quality, suffix, toxicity, urls, warc

QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_warc": warc.op4_warc,
    "op5_quality": quality.op5_quality,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_license_scan": license.op7_license_scan,
    "op8_packing": packing.op8_packing,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_neardup": neardup.op10_neardup,
}
ORACLE: dict[str, str] = {
    "op1_url_filters": urls.ORACLE,
    "op4_warc": warc.ORACLE,
    "op7_license_scan": license.ORACLE,
    "op10_neardup": neardup.ORACLE,
}

"""Queries of this subpackage: ``name -> fn(spark, sf_dir)``, and the SQL of those it can express."""

from __future__ import annotations

from spantide.llm import (fingerprints, licenses, linededup, merkle, minhash, mixing, negatives, packing, quality, separators, suffixes,
                          topk, warc)

QUERIES = {
    "op1_minhash_near_dedup": minhash.query,
    "op2_best_fit_packing": packing.query,
    "op3_quality_rules": quality.query,
    "op4_warc_roundtrip": warc.query,
    "op5_license_scan": licenses.query,
    "op6_cws_fingerprints": fingerprints.query,
    "op7_suffix_dedup": suffixes.query,
    "op8_source_mixing": mixing.query,
    "op9_line_dedup": linededup.query,
    "op10_token_counts": separators.query,
    "op11_hard_negatives": negatives.query,
    "op12_exact_topk": topk.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE = {
    "op3_quality_rules": quality.ORACLE_SQL,
    "op4_warc_roundtrip": warc.ORACLE_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op9_line_dedup": linededup.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_exact_topk": topk.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}

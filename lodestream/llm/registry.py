"""The queries of this package and their SQL."""

from __future__ import annotations

from . import dartminhash, iblt, mixing, packing, passages, secrets, suffixes, topk, toxicity, warc

QUERIES = {
    "op1_substring_dedup": passages.op1_substring_dedup,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": iblt.op6_fingerprints,
    "op7_warc_roundtrip": warc.op7_warc_roundtrip,
    "op8_pack": packing.op8_pack,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_near_duplicates": dartminhash.op10_near_duplicates,
}
ORACLES = {"op2_mix_sources": mixing.OP2_SQL, "op7_warc_roundtrip": warc.OP7_SQL, "op9_exact_topk": topk.OP9_SQL}

"""The training-data queries and their SQL oracles."""

from __future__ import annotations

from . import clustering, licenses, media, mixing, near_dups, packing, pseudonyms, quality, resampling, sharding, suffixes, token_files, topk

QUERIES = {
    "op1_media": media.op1_media,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_topk": topk.op4_topk,
    "op5_near_dups": near_dups.op5_near_dups,
    "op6_packing": packing.op6_packing,
    "op7_pseudonyms": pseudonyms.op7_pseudonyms,
    "op8_quality": quality.op8_quality,
    "op9_licenses": licenses.op9_licenses,
    "op10_token_files": token_files.op10_token_files,
    "op11_repeats": suffixes.op11_repeats,
    "op12_resampling": resampling.op12_resampling,
    "op13_clusters": clustering.op13_clusters,
}
ORACLES: dict[str, str] = {"op4_topk": topk.ORACLE, "op13_clusters": clustering.ORACLE}

"""The operators' queries by their registered names, and SQL where SQL can express one."""

from __future__ import annotations

from . import ann, bpe, language_id, line_crf, mixing, pu_quality, secret_scan, simhash, spelling, suffix_dedup, tokenfile, vq, wrapper

QUERIES = {
    "op1_line_crf_quality": line_crf.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_wrapper_induction": wrapper.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_byte_bpe": bpe.query,
    "op6_pu_quality": pu_quality.query,
    "op7_language_id": language_id.query,
    "op8_pruned_graph_ann": ann.query,
    "op9_mix_sources": mixing.query,
    "op10_token_files": tokenfile.query,
    "op11_zstd_novelty": secret_scan.query,
    "op12_filtering_lloyd": vq.query,
    "op13_spelling_variants": spelling.query,
}
ORACLE_SQL: dict[str, str] = {"op9_mix_sources": mixing.SQL, "op12_filtering_lloyd": vq.SQL, "op13_spelling_variants": spelling.SQL}

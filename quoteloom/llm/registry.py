"""Queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from . import chunk_dedup, langid, mixing, near_join, packing, pii, quality, rollups, secrets, suffix_dedup, token_files, wavelet_search, whitening

QUERIES: dict[str, Callable] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_exact_dedup": chunk_dedup.op3_exact_dedup,
    "op4_ngram_join": near_join.op4_ngram_join,
    "op5_packing": packing.op5_packing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_files": token_files.op7_token_files,
    "op8_mixing": mixing.op8_mixing,
    "op9_language_id": langid.op9_language_id,
    "op10_token_rollup": rollups.op10_token_rollup,
    "op11_lexical_search": wavelet_search.op11_lexical_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_personal_data": pii.op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": chunk_dedup.ORACLE,
    "op11_lexical_search": wavelet_search.ORACLE,
}

"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from bookflow.llm import html_text, language_id, media, merkle_manifest, mixing, ngram_join, pii, pivot_search, sentencepiece_lattice, simhash_index, substring_dedup, token_alignment, token_counts

_QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_pivot_search": pivot_search.op3_pivot_search,
    "op4_language_id": language_id.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_html_text": html_text.op6_html_text,
    "op7_media": media.op7_media,
    "op8_sentencepiece": sentencepiece_lattice.op8_sentencepiece,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle": merkle_manifest.op11_merkle,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_simhash": simhash_index.op13_simhash,
}
_ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_pivot_search": pivot_search.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op11_merkle": merkle_manifest.ORACLE,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)

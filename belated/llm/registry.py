"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprint, html, language, minhash, packing, quality, sentencepiece, suffix, toxicity, warc

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_line_blocks": html.op4_line_blocks,
    "op5_compression_bands": quality.op5_compression_bands,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_iblt_fingerprint": fingerprint.op7_iblt_fingerprint,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op8_warc": warc.OP8_SQL}

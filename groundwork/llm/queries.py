"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from groundwork.llm import bpe, embedding, lines, ogg, packing, simhash, suffix, token_files, toxicity, urls

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_token_files": token_files.query,
    "op4_suffix_dedup": suffix.query,
    "op5_url_filter": urls.query,
    "op6_byte_bpe": bpe.query,
    "op7_toxicity": toxicity.query,
    "op8_ogg_media": ogg.query,
    "op9_packing": packing.query,
    "op10_embedding_near_dedup": embedding.query,
}

ORACLE_SQL = {"op5_url_filter": urls.oracle()}

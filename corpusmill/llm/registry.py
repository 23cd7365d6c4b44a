"""The operators' queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import centroids, chat_format, embedding_dedup, hard_negatives, language_id, lm_scoring, mixing, ngram_join, piece_fst, quality, sharding, token_files, topk_search


def queries() -> dict:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality": quality.op3_quality,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_sharding": sharding.op6_sharding,
        "op7_pieces": piece_fst.op7_pieces,
        "op8_token_files": token_files.op8_token_files,
        "op9_language_id": language_id.op9_language_id,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_lm_scoring": lm_scoring.op12_lm_scoring,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk_search.SQL,
        "op2_mixing": mixing.mix_sql(),
        "op5_chat_format": chat_format.SQL,
        "op10_embedding_dedup": embedding_dedup.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op13_centroids": centroids.SQL,
    }

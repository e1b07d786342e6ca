"""Registered queries of this subpackage, and their SQL where it can express them."""

from agrolith.llm import embedding_dedup, exact_dedup, hard_negatives, language_id, lm_score, minhash_dedup, mixing, quality, sentencepiece_codec, target_resampling, token_orc, url_filter, warc

QUERIES = {
    "op4_sentencepiece": sentencepiece_codec.op4,
    "op7_minhash_dedup": minhash_dedup.op7,
    "op2_exact_dedup": exact_dedup.op2,
    "op5_language_id": language_id.op5,
    "op8_mix_sources": mixing.op8,
    "op10_token_orc": token_orc.op10,
    "op3_lm_score": lm_score.op3,
    "op6_embedding_dedup": embedding_dedup.op6,
    "op9_quality": quality.op9,
    "op1_url_filter": url_filter.op1,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_warc": warc.op12,
    "op13_target_resampling": target_resampling.op13,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op7_minhash_dedup": minhash_dedup.ORACLE,
    "op1_url_filter": url_filter.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_target_resampling": target_resampling.ORACLE,
}

"""Queries of this folder and their DuckDB counterparts."""

from __future__ import annotations

from tallyforge.llm import chat_format as chat
from tallyforge.llm import class_lm
from tallyforge.llm import decontaminate as decon
from tallyforge.llm import embedding_dedup as vectors
from tallyforge.llm import hard_negatives
from tallyforge.llm import language_id as language
from tallyforge.llm import licenses
from tallyforge.llm import manifest, minhash, pieces, quality, sharding, substring_dedup

QUERIES = {
    "op1_decontaminate": decon.op1_decontaminate,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language.op4_language_id,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_near_vectors": vectors.op7_near_vectors,
    "op8_class_lm": class_lm.op8_class_lm,
    "op9_chat_format": chat.op9_chat_format,
    "op10_near_duplicates": minhash.op10_near_duplicates,
    "op11_shard": sharding.op11_shard,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_manifest": manifest.op13_manifest,
}
ORACLES = {
    "op1_decontaminate": decon.OP1_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op10_near_duplicates": minhash.OP10_SQL,
    "op11_shard": sharding.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_manifest": manifest.OP13_SQL,
}

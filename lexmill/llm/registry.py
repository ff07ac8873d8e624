"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, conversations, fingerprints, lexical, licenses, line_dedup, mixing, ngram_join, quality, secrets, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {"op1_license_scan": licenses.op1_license_scan, "op2_line_dedup": line_dedup.op2_line_dedup, "op3_mixing": mixing.op3_mixing, "op4_sharding": sharding.op4_sharding, "op5_byte_bpe": bpe.op5_byte_bpe, "op6_ngram_join": ngram_join.op6_ngram_join, "op7_quality_rules": quality.op7_quality_rules, "op8_secret_scan": secrets.op8_secret_scan, "op9_fingerprints": fingerprints.op9_fingerprints, "op10_toxicity": toxicity.op10_toxicity, "op11_lexical_search": lexical.op11_lexical_search, "op12_conversation_repair": conversations.op12_conversation_repair, "op13_substring_dedup": substring_dedup.op13_substring_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.OP1_SQL, "op2_line_dedup": line_dedup.OP2_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op7_quality_rules": quality.OP7_SQL, "op8_secret_scan": secrets.OP8_SQL, "op11_lexical_search": lexical.OP11_SQL, "op12_conversation_repair": conversations.OP12_SQL, "op13_substring_dedup": substring_dedup.OP13_SQL}

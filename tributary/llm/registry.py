"""Queries of this subpackage and their SQL counterparts."""

from . import bpe, divergence, importance, langid, merkle, mixing, pii_sanitise, quality_cnn, quality_rules, simhash_dedup, token_files, toxicity_mil, url_filter

QUERIES = {
    "op1_simhash_dedup": simhash_dedup.op1_simhash_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_cnn": quality_cnn.op5_quality_cnn,
    "op6_bpe": bpe.op6_bpe,
    "op7_toxicity": toxicity_mil.op7_toxicity,
    "op8_pii": pii_sanitise.op8_pii,
    "op9_merkle": merkle.op9_merkle,
    "op10_langid": langid.op10_langid,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_token_files": token_files.op12_token_files,
    "op13_importance": importance.op13_importance,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}

"""The thin queries of the subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from graphloom.llm import audit, langid, media, mixing, pieces, pii, quality, resample, rollups, simhash, substrings, toxicity, warc
from graphloom.session import table


def _over(module, *names):
    return lambda spark, sf_dir: module.query(*(table(spark, sf_dir, n) for n in names))


QUERIES = {
    "op1_sentencepiece_dropout": _over(pieces, "documents"),
    "op2_simhash_near_dedup": _over(simhash, "documents"),
    "op3_media_sequences": _over(media, "documents"),
    "op4_quality_rules": _over(quality, "documents"),
    "op5_personal_data": _over(pii, "documents"),
    "op6_token_rollups": _over(rollups, "documents"),
    "op7_toxicity": _over(toxicity, "documents", "labels"),
    "op8_source_mixing": _over(mixing, "documents"),
    "op9_language_codewords": _over(langid, "documents"),
    "op10_warc_packages": _over(warc, "pages"),
    "op11_filter_audit": _over(audit, "documents", "labels"),
    "op12_target_resampling": _over(resample, "documents", "benchmark"),
    "op13_substring_dedup": _over(substrings, "documents"),
}

ORACLE_SQL = {
    "op4_quality_rules": quality.SQL,
    "op8_source_mixing": mixing.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_target_resampling": resample.SQL,
    "op13_substring_dedup": substrings.SQL,
}

"""The queries of this subpackage and, where SQL can express them, their oracles."""

from . import bpe, conversation_repair, decontaminate, html_extract, jaccard_join, language_id, license_scan, line_dedup, media, merkle, pitman_yor, substring_dedup, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_media": media.op2_media,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_language_id": language_id.op5_language_id,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_lm_scoring": pitman_yor.op11_lm_scoring,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op1_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}

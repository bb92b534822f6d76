"""The queries of this subpackage, by the names that __spark_entry__.py registers, and their SQL where SQL can say it."""

from __future__ import annotations

from ledgerline.llm import (
    op1_sentencepiece,
    op2_media,
    op3_packing,
    op4_near_dedup,
    op5_url_filter,
    op6_line_dedup,
    op7_exact_dedup,
    op8_license_scan,
    op9_language_id,
    op10_quality,
    op11_spelling,
    op12_conversation_repair,
    op13_secret_scan,
)

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece.op1_sentencepiece,
    "op2_media_columns": op2_media.op2_media_columns,
    "op3_packing": op3_packing.op3_packing,
    "op4_near_dedup": op4_near_dedup.op4_near_dedup,
    "op5_url_filter": op5_url_filter.op5_url_filter,
    "op6_line_dedup": op6_line_dedup.op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup.op7_exact_dedup,
    "op8_license_scan": op8_license_scan.op8_license_scan,
    "op9_language_id": op9_language_id.op9_language_id,
    "op10_quality_classifier": op10_quality.op10_quality_classifier,
    "op11_spelling_variants": op11_spelling.op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair.op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan.op13_secret_scan,
}

ORACLE_SQL = {
    "op5_url_filter": op5_url_filter.ORACLE_SQL,
    "op7_exact_dedup": op7_exact_dedup.ORACLE_SQL,
}

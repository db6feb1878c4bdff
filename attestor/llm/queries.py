"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from attestor.llm import bpe, chat_format, decontaminate, license_scan, media, near_dup, pii, quality, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op7_proximity": decontaminate.op7_proximity,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_media": media.op9_media,
    "op10_chat_format": chat_format.op10_chat_format,
}

#: DuckDB SQL, where SQL can express the query over whole tables.
ORACLE_SQL = {
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_near_dup": near_dup.OP8_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
}

"""The text operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitscope.llm import bpe, chat, langid, orderminhash, packing, pages, privacy, quality, repair, sharding, simhash, spelling, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1,
    "op2_sharding": sharding.op2,
    "op3_order_minhash": orderminhash.op3,
    "op4_html_text": pages.op4,
    "op5_packing": packing.op5,
    "op6_language_id": langid.op6,
    "op7_substring_dedup": substrings.op7,
    "op8_chat_formatting": chat.op8,
    "op9_quality_rules": quality.op9,
    "op10_simhash": simhash.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_pii": privacy.op12,
    "op13_conversation_repair": repair.op13,
}

SQL: dict[str, str] = {
    "op7_substring_dedup": substrings.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
}

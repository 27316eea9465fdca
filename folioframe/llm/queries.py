"""The queries that apply the ten operators to their whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, lines, mixing, rulefit, shards, simhash, warc


QUERIES = {
    "op1_line_quality": lines.op1_line_quality,
    "op2_interleaved_shards": shards.op2_interleaved_shards,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat_format": chat.op4_chat_format,
    "op5_token_counts": bpe.op5_token_counts,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": rulefit.op7_quality_rules,
    "op8_language_id": langid.op8_language_id,
    "op9_warc": warc.op9_warc,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

SQL = {"op1_line_quality": lines.SQL, "op3_mixing": mixing.SQL, "op4_chat_format": chat.SQL, "op9_warc": warc.SQL, "op10_decontaminate": decontaminate.SQL}

"""The operators' queries and their SQL, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, pii, simhash_golay, toxicity

MODULES = {
    "op1_toxicity": toxicity,
    "op2_chat_format": chat_format,
    "op3_simhash_golay": simhash_golay,
    "op4_pii": pii,
    "op5_license_scan": license_scan,
    "op6_language_id": language_id,
    "op7_line_dedup": line_dedup,
    "op8_mixing": mixing,
    "op9_decontaminate": decontaminate,
    "op10_exact_dedup": exact_dedup,
}

QUERIES = {name: m.query for name, m in MODULES.items()}
SQL = {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}

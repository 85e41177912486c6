"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module.  A module's ``SQL``, where it has one, is the same query for DuckDB.
MODULES = {
    "op1_simhash": "simhash",
    "op2_pii": "pii",
    "op3_bpe": "bpe",
    "op4_line_dedup": "line_dedup",
    "op5_mixing": "mixing",
    "op6_exact_dedup": "exact_dedup",
    "op7_secrets": "secrets",
    "op8_toxicity": "toxicity",
    "op9_langid": "langid",
    "op10_vectors": "vectors",
}


def _module(name: str):
    return import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "SQL", None))}

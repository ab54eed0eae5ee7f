"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

# query name -> module that defines a function of that name
_QUERIES = {
    "op2_near_texts": "near_texts",
    "op1_near_vectors": "near_vectors",
    "op5_warc_revisits": "warc",
    "op7_secrets": "secrets",
    "op10_chat": "chat",
    "op3_byte_bpe": "byte_bpe",
    "op4_packing": "packing",
    "op9_token_files": "token_files",
    "op6_pii": "pii",
    "op8_quality_rules": "quality",
    # the spans of op6 and op7 that the contract fixes, without those that the method adds: what SQL can express
    "pii_base_spans": "pii",
    "secrets_base_spans": "secrets",
}


def _lazy(module: str, name: str):
    def query(spark, sf_dir: str):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _lazy(module, name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict:
    from .oracles import SQL

    return dict(SQL)

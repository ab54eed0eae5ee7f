"""Fault-tolerant reading of one SQL statement: tokens, syntax tree, object references, column lineage."""

from .analyze import Analysis, analyze
from .lexer import Token, tokenize

__all__ = ["Analysis", "Token", "analyze", "tokenize"]

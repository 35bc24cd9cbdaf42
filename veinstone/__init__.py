"""A Spark-first SQL engine and operator library."""

from veinstone.api import Engine, collect, derived_alias, extract_tables, tokenize

__all__ = ["Engine", "collect", "derived_alias", "extract_tables", "tokenize"]

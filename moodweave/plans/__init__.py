"""The registered queries over the driver's tables, each with independent DuckDB SQL."""

from . import lexicon_queries, model_queries, text_queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "lexicon_queries", "model_queries", "text_queries"]

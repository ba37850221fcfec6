"""All registered queries. Importing the modules fills the registry."""

from . import comparison_queries, profile_queries, table_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

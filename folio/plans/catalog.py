"""The registered queries of the library and the SQL that checks them."""

from . import document_queries, facet_queries, form_queries, record_queries, stream_queries, structure_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All registered queries and their SQL."""

from . import corpus, retrieval, search  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

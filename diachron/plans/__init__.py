"""Named queries composed from the operators, with their oracle SQL."""

from . import network_queries, predict_queries, retrieval_queries, text_queries  # noqa: F401
from .catalog import QUERIES, SQL

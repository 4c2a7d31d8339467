"""All registered queries and their oracles."""

from riskloom.catalog import cleaning, evaluation, features, modeling, resampling  # noqa: F401
from riskloom.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""The checked queries, one per operator."""

from . import chain, clients, features, groups, models, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

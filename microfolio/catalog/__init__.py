"""Registered queries, each with its SQL counterpart for comparison where SQL can express it."""

from . import allocation, behaviour, contracts, quality, reconciliation, relational, refresh, scoring, service, serving, sources, warehouse
from .base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]

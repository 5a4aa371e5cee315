"""Registered queries with their DuckDB SQL, by area."""

from . import core, learning, series, stages, statistics, systems  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""Queries over the driver tables, each with its ANSI SQL twin."""

from filmloom.bindings import filters, functions, joins, ranking, sources  # noqa: F401
from filmloom.bindings.registry import ORACLES, QUERIES  # noqa: F401

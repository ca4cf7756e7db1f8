"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in `body`: it is evaluated once per row and stands once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)

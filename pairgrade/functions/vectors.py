"""Array expressions that evaluate each part once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated for every element and is
    not shared by common-subexpression elimination.  Binding it as a lambda
    variable of a one-element array makes it a plain value.
    """
    return F.get(F.transform(F.array(value), body), 0)

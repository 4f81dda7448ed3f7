"""Naming an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it.

    Columns are expressions, so that what is used twice is written out twice; nested a few times over, an expression
    grows past what can be compiled.  Here value is bound to the variable of a one-element transform().
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

"""Values computed once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row. Without this, an expression that uses a value n times holds n copies of it, and nested ones grow without bound.

    A body may not use the value of a bind() around it in the body of one within it: Spark then fails
    to find Python functions that are given the expression. Bind a struct of both values instead.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]

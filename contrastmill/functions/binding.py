"""Computing an intermediate value once inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Expressions over arrays are evaluated as written, so a value used several times in one is
    computed several times unless it is a variable.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))

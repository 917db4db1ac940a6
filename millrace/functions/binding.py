"""Names for intermediate values inside of one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row.

    An expression that a lambda refers to is computed anew for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

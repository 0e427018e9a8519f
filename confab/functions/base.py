"""What the function modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once. An expression that a lambda of an array function refers to is evaluated for
    each element, also where it stands in a column of its own that the optimiser merges; a lambda's variable is not."""
    return F.element_at(F.transform(F.array(value), body), 1)

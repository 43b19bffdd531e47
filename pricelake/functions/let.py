"""Names inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    Without a name Catalyst copies an expression to each place that uses it,
    and folds of folds grow past what the optimizer and code generation take.
    """
    return F.transform(F.array(value), body).getItem(0)

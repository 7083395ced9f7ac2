"""Column expressions and scalar functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(returns: str) -> Callable:
    """An Arrow function over columns that is made when it is first used, so that importing needs no session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap

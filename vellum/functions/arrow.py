"""Arrow functions made when they are first used, so that modules can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def arrow_udf(schema: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf`` with a schema string, but bound to the session of each use.

    ``once`` marks a costly function as not deterministic: a filter on its result then does not run it a second time."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            made = pandas_udf(f, schema)
            return (made.asNondeterministic() if once else made)(*columns)

        return call

    return wrap

"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, dates: str = "", rounded: str = "", places: int = 4):
        """dates and rounded name columns that both sides give as text and rounded; sql may leave both to this."""

        def register(f: Callable) -> Callable:
            def run(spark, sf_dir: str) -> DataFrame:
                df = f(spark, sf_dir)
                return df.withColumns({c: F.col(c).cast("string") for c in dates.split()} | {c: F.round(F.col(c).cast("double"), places) for c in rounded.split()})

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                changed = [f"{c}::varchar as {c}" for c in dates.split()] + [f"round({c}::double, {places}) as {c}" for c in rounded.split()]
                self.oracle[f.__name__] = f"select * replace ({', '.join(changed)}) from ({sql})" if changed else sql
            return f

        return register

"""Recursive queries over a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = "spark.sql.cteRecursionRowLimit"


def recursive(rows: DataFrame, sql: str) -> DataFrame:
    """What a recursive query says of ``rows``, which it calls {rows}.

    Trees of a whole collection are walked in one recursion, so it has no row limit; that setting is read when the query runs,
    so it is set on the session, once. What it gives has as many partitions as its first level, so queries take all rows into that
    level and mark those that are roots (``live``): the others meet nothing and are left out at the end.
    """
    spark = rows.sparkSession
    if spark.conf.get(LIMIT, None) != "-1":
        spark.conf.set(LIMIT, "-1")
    return spark.sql(sql, rows=rows)  # a view that lives as long as the call

"""Running values over groups of any length: rows are worked out span by span, and each span is told what those before it left.

A span has the rows of SPAN places of the order column, which is a whole number, so no task sorts a whole group. What the spans
leave is a row per span. Rows are read twice, once for that; who computes them at some cost writes or keeps them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16


def _joined(spanned: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return spanned.alias("a").join(left.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in left.columns if c not in keys])


def last_before(rows: DataFrame, group: list[str], order: str, values: dict[str, Column], span: int | None = None) -> DataFrame:
    """``rows`` with, by name, the last value before each row of its group that is not null; null where there is none."""
    keys = [*group, "_span"]
    spanned = rows.withColumn("_span", F.floor(F.col(order) / (span or SPAN))).select("*", *[v.alias(f"_{n}") for n, v in values.items()])
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    left = spanned.groupBy(*keys).agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_{n}") for n in values])
    left = left.select(*keys, *[F.last(f"_{n}", ignorenulls=True).over(behind).alias(f"_left_{n}") for n in values])
    found = spanned.select("*", *[F.last(f"_{n}", ignorenulls=True).over(inside).alias(f"_in_{n}") for n in values])
    return _joined(found, left, keys).select(*[f"`{c}`" for c in rows.columns], *[F.coalesce(f"_in_{n}", f"_left_{n}").alias(n) for n in values])


def count_so_far(rows: DataFrame, group: list[str], order: str, name: str, what: Column, span: int | None = None) -> DataFrame:
    """``rows`` with ``name``, how many rows of the group up to and with each are ``what``."""
    keys = [*group, "_span"]
    spanned = rows.withColumn("_span", F.floor(F.col(order) / (span or SPAN))).withColumn("_what", F.coalesce(what, F.lit(False)))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    left = spanned.groupBy(*keys).agg(F.count_if("_what").alias("_here")).select(*keys, F.coalesce(F.sum("_here").over(behind), F.lit(0)).alias("_left"))
    found = spanned.withColumn("_in", F.count_if("_what").over(inside))
    return _joined(found, left, keys).select(*[f"`{c}`" for c in rows.columns], (F.col("_in") + F.col("_left")).alias(name))

"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, read

#: Rows of a source are dealt to so many ranges of their seeded key; sums by range give prefix sums without sorting a source in one task.
RANGE_DIGITS = 3


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets for ``sources`` (source, source_size, weight): min(cap, level x weight), with one level for all.

    The level is the one at which targets add up to ``share`` of all sizes; clamping a source at its cap and sharing the
    excess by weight again and again ends there. Sorted by the level at which each source is full, it is found from running
    sums. One row per source comes in, so the window sorts sources, never documents. Adds ``target``; a share above
    max_epochs fills every source. Null sources are a source of their own.
    """
    full = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        full.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .drop("cap", "full_at", "level")
    )


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Sources by code point, null last, weigh ``weights`` in turn."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (rank - 1) % len(weights)).cast("double"))


def sample_key(seed: int, doc_id: str = "doc_id") -> Column:
    """A row's place in its source's seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def mix_plan(sized: DataFrame, seed: int = 7, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """What each source gives, one row per source, from ``sized`` (source, size, key, doc_id).

    A source is taken ``whole`` times, then once more as far as its ``budget`` goes in the order of key and doc_id: rows up to
    (last_key, last_id), and of the rows behind it the one (fill_key, fill_id) whose size comes nearest to what is left, if
    that is nearer than none. Columns: source, source_size, target, whole, last, fill (structs of key and doc_id, or null).
    """
    by_range = sized.withColumn("part", F.substring("key", 1, RANGE_DIGITS)).groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    by_range = materialize(by_range, "mix-ranges")
    targets = water_fill(cycle_weights(by_range.groupBy("source").agg(F.sum("part_size").alias("source_size"))), share, max_epochs)
    budget = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    targets = (
        targets.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
        .withColumn("budget", budget)
        .select("source", "source_size", "target", "whole", "budget")
    )
    targets = materialize(targets, "mix-targets")
    behind = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("t.source").eqNullSafe(F.col("r.source"))
    edges = by_range.withColumn("before", F.coalesce(F.sum("part_size").over(behind), F.lit(0))).alias("r").join(targets.alias("t"), mine)
    edge = F.col("before") <= F.col("budget")
    edges = edges.where(edge).groupBy("r.source").agg(F.max_by(F.struct("part", "before", "budget"), "part").alias("e")).select("source", "e.*")
    # only the range in which a source's budget ends is put in order
    inside = sized.alias("s").join(edges.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source")) & (F.substring("s.key", 1, RANGE_DIGITS) == F.col("r.part")))
    run = Window.partitionBy("s.source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        inside.withColumn("sum", F.col("before") + F.sum("size").over(run))
        .groupBy("s.source", "part", "before", "budget")
        .agg(F.max(F.when(F.col("sum") <= F.col("budget"), F.struct("sum", "key", "doc_id"))).alias("c"))
        .select(
            "source",
            F.coalesce("c.sum", "before").alias("sum"),
            # where nothing of the range fits, what lies before it does: a range's digits sort before its keys
            F.when(F.col("budget") > 0, F.struct(F.coalesce("c.key", "part").alias("key"), F.col("c.doc_id").alias("doc_id"))).alias("last"),
        )
    )
    plan = targets.alias("t").join(cut.alias("r"), mine, "left").select("t.*", "last", F.coalesce(F.col("budget") - F.col("sum"), F.lit(0.0)).alias("left"))
    plan = materialize(plan, "mix-plan")
    left = F.struct("s.key", "s.doc_id")
    fill = (
        sized.alias("s")
        .join(plan.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .where((F.col("left") > 0) & (F.col("size") > 0) & (F.col("last").isNull() | (left > F.col("last"))))
        .where(F.abs(F.col("size") - F.col("left")) < F.col("left"))
        .groupBy("s.source")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), F.col("s.key"), F.col("s.doc_id"))).alias("f"))
        .select("source", F.struct("f.key", "f.doc_id").alias("fill"))
    )
    return materialize(plan.alias("t").join(fill.alias("r"), mine, "left").select("t.source", "source_size", "target", "whole", "last", "fill"), "mix-fill")


def sizes_of(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size and key of every row, kept in the shared folder: texts are read once for all that follows."""
    return materialize(docs.select("doc_id", "source", word_count().alias("size"), sample_key(seed).alias("key")), "mix-sizes")


def planned(rows: DataFrame, plan: DataFrame, key: Column) -> DataFrame:
    """``rows`` (doc_id, source, ...) with source_size, target and copies as the plan says; ``key`` is a row's :func:`sample_key`."""
    me = F.struct(key.alias("key"), F.col("s.doc_id"))
    extra = F.coalesce((me <= F.col("t.last")) | F.col("t.fill").eqNullSafe(me), F.lit(False))
    return (
        rows.alias("s")
        .join(plan.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.*", "t.source_size", "t.target", (F.col("t.whole") + F.when(extra, 1).otherwise(0)).alias("copies"))
    )


def mix(docs: DataFrame, seed: int = 7, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies``, the times that the mix repeats the row, of all rows of ``docs``.

    Only doc_id, source and text are looked at. A null text has size 0, null sources form one source, a null doc_id sorts
    first. Rows that agree in doc_id share a key and so a decision. Sums by range of the key and one plan row per source are all
    that crosses a shuffle besides (source, size, key).
    """
    narrow = sizes_of(docs, seed)
    return planned(narrow, mix_plan(narrow, seed, share, max_epochs, weights), F.col("s.key")).drop("key")


def mixed(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``docs``, all columns, each row as many times as :func:`mix` repeats it, down to none.

    A null text, and one without words, has size 0, so that it is repeated as often as its source is whole; a null source is a
    source of its own, that comes last. Ties of the draw go by doc_id; rows that agree in it fare as :func:`mix` says. An empty table stays empty. Columns keep their names and values, whatever they are called.
    """
    plan = mix_plan(sizes_of(docs, seed), seed, **options)
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    repeated = planned(whole, plan, sample_key(seed, "s.doc_id")).select("row", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
    CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources
), targets AS (
  SELECT source, source_size, CAST(least(cap, weight * (SELECT max(level) FROM levels WHERE level <= cap / weight)) AS DOUBLE) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets
), runs AS (
  SELECT s.doc_id, s.source, s.size, s.key, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
), remains AS (
  SELECT source, budget - coalesce(max(run) FILTER (WHERE run <= budget), 0) AS remain FROM runs GROUP BY source, budget
), fills AS (
  SELECT r.source, arg_min(r.doc_id, (abs(r.size - m.remain), r.key)) AS fill FROM runs r JOIN remains m ON r.source IS NOT DISTINCT FROM m.source
  WHERE r.run > r.budget AND r.size > 0 AND m.remain > 0 AND abs(r.size - m.remain) < m.remain GROUP BY r.source
)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(r.size * (r.whole + CASE WHEN r.run <= r.budget OR r.doc_id = f.fill THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs r LEFT JOIN fills f ON r.source IS NOT DISTINCT FROM f.source
"""

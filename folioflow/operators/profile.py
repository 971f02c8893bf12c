"""Figures about a collection: outlines, roles, texts, special characters, and how timings changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx


def number_format(title: Column) -> Column:
    """How a title is numbered: annex, appendix, dotted (1.2), dot-ended (1.), plain (1), or none."""
    t = tx.trim(tx.strip_invisible(title))
    return (
        F.when(F.rlike(t, F.lit("^(?i:annex) ")), "annex")
        .when(F.rlike(t, F.lit("^(?i:appendix) ")), "appendix")
        .when(F.rlike(t, F.lit("^[0-9]+(\\.[0-9]+)+ ")), "dotted")
        .when(F.rlike(t, F.lit("^[0-9]+\\. ")), "dot-ended")
        .when(F.rlike(t, F.lit("^[0-9]+ ")), "plain")
        .otherwise("none")
    )


def outline_profile(tree: DataFrame) -> DataFrame:
    """Per document: entries, top-level entries, deepest level, entries without a page."""
    return tree.groupBy("spec_id").agg(F.count("*").alias("entries"), F.count_if(F.col("depth") == 0).alias("top_level"), F.max("depth").alias("max_depth"), F.count_if(F.col("page") < 1).alias("unresolved"))


def number_formats(titles: DataFrame) -> DataFrame:
    return titles.groupBy(number_format(F.col("title")).alias("format")).agg(F.count("*").alias("n"))


def role_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.where("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n"))


def to_depth(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes no deeper than ``depth`` below the top (spec_id, page, role, level from 0): one join per level."""
    level = nodes.where("parent_id IS NULL").select("spec_id", "page", "node_id", "role", F.lit(0).alias("level"))
    out = level
    for n in range(1, depth + 1):
        above = level.select("spec_id", "page", F.col("node_id").alias("parent_id"))
        level = nodes.select("spec_id", "page", "node_id", "parent_id", "role").join(above, ["spec_id", "page", "parent_id"]).select("spec_id", "page", "node_id", "role", F.lit(n).alias("level"))
        out = out.unionByName(level)
    return out.drop("node_id")


def has_tables(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Per document, whether a table stands within ``depth`` levels, and the roles found there."""
    return to_depth(nodes, depth).groupBy("spec_id").agg(F.coalesce(F.bool_or(F.col("role") == "Table"), F.lit(False)).alias("has_table"), F.array_sort(F.collect_set("role")).alias("roles"))


def text_profile(pages: DataFrame, sample: int = 200) -> DataFrame:
    """Per document: pages, characters, the shortest and longest page, and how its first page that is not blank begins."""
    n = F.length("text")
    begins = F.min_by(F.substring("text", 1, sample), F.when(F.rlike("text", F.lit(r"\S")), F.col("page")))
    return pages.groupBy("spec_id").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"), begins.alias("sample"))


def special_characters(pages: DataFrame, column: str = "text") -> DataFrame:
    """Per document, on how many pages tabs, invisible characters and double spaces are."""
    has = {"tabs": "\t", "invisible": tx.INVISIBLE, "double_spaces": "  "}
    return pages.groupBy("spec_id").agg(*[F.count_if(F.rlike(column, F.lit(p))).alias(k) for k, p in has.items()])


def summary(specs: DataFrame, *profiles: DataFrame) -> DataFrame:
    """A row per document with what the profiles say; a document that they do not know is marked ``failed``."""
    out = specs.select("spec_id")
    for i, p in enumerate(profiles):
        out = out.join(p.withColumn(f"_has_{i}", F.lit(True)), "spec_id", "left")
    missing = [F.col(f"_has_{i}").isNull() for i in range(len(profiles))]
    failed = missing[0] if missing else F.lit(False)
    for m in missing[1:]:
        failed |= m
    return out.withColumn("failed", failed).drop(*[f"_has_{i}" for i in range(len(profiles))])


def title_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections whose normalised titles both documents have, the last of each counting (norm, old_section, new_section)."""
    last = [s.withColumn("norm", tx.norm_title(F.col("title"))).where("norm <> ''").groupBy("norm").agg(F.max_by("section", "ord").alias(name)) for s, name in ((old, "old_section"), (new, "new_section"))]
    return last[0].join(last[1], "norm")


def regressions(now: DataFrame, baseline: DataFrame, most: float = 20.0) -> DataFrame:
    """Operations (name, ms) that take over ``most`` per cent longer than in the baseline; a baseline of nothing has no change."""
    both = now.select("name", F.col("ms").alias("now_ms")).join(baseline.select("name", F.col("ms").alias("base_ms")), "name")
    change = F.when(F.col("base_ms") > 0, (F.col("now_ms") - F.col("base_ms")) * 100.0 / F.col("base_ms")).otherwise(F.lit(0.0))
    return both.withColumn("change", change).withColumn("slower", F.col("change") > most)


def changes(timings: DataFrame) -> DataFrame:
    """Runs of each operation (name, run, ms) with the change against the run before, in per cent."""
    before = F.lag("ms").over(Window.partitionBy("name").orderBy("run"))
    return timings.withColumn("change", F.when(before > 0, (F.col("ms") - before) * 100.0 / before))

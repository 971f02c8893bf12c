"""Phrase and all-words search over pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx


def page_text(text_items: DataFrame) -> DataFrame:
    """The text of each page (spec_id, page, text): its text items in order, joined by spaces, running heads and feet included."""
    items = text_items.where("kind = 'text'").groupBy("spec_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "str"))).alias("items"))
    return items.select("spec_id", "page", F.array_join("items.str", " ").alias("text"))


def index(pages: DataFrame) -> DataFrame:
    """``pages`` (spec_id, page, section, text) with ``norm``, the text as searches read it: what is kept is not normalised again by each query."""
    return pages.withColumn("norm", tx.norm_search(F.col("text")))


def score_pages(pages: DataFrame, query: str) -> DataFrame:
    """Pages that the query hits, with score, snippet. ``pages`` may have come through :func:`index`.

    A page that holds the whole query scores three for each time; else one that holds every one of several words scores one for
    each time of each. Words are looked for inside words too. The normalised text is computed once per page.
    """
    phrase = tx.norm_query(query)
    words = [w for w in re.split(tx.WS + "+", phrase) if w]
    def held(nt: Column) -> Column:
        return nt.contains(phrase)

    def hit(nt: Column) -> Column:
        out = held(nt)
        if len(words) >= 2:
            every = nt.contains(words[0])
            for w in words[1:]:
                every &= nt.contains(w)
            out |= every
        return out

    def scored(nt: Column) -> Column:
        total = F.lit(0).cast("long")
        for w in words:
            total += tx.count_occurrences(nt, w)
        first = F.least(*[tx.index_of(nt, w) for w in words]) if len(words) > 1 else F.lit(-1)
        return F.struct(
            F.when(held(nt), 3 * tx.count_occurrences(nt, phrase)).otherwise(total).alias("score"),
            F.when(held(nt), tx.index_of(nt, phrase)).otherwise(first).alias("at"),
            F.length(nt).alias("normal_length"),
        )

    # a generator of one row or none: the text is normalised once, not again for the filter and each result
    if "norm" in pages.columns:
        hits = pages.where(hit(F.col("norm"))).select("*", scored(F.col("norm")).alias("x")).select("*", "x.*").drop("x", "norm")
    else:
        hits = pages.select("*", F.inline(F.transform(F.filter(F.array(tx.norm_search(F.col("text"))), hit), scored)))
    return hits.withColumn("snippet", tx.snippet(F.col("text"), F.col("at"), F.col("normal_length"), len(query))).drop("at", "normal_length")


def search(pages: DataFrame, query: str, max_results: int | None = 10, per_spec: bool = True) -> DataFrame:
    """The best page of each section, best first: spec_id, section, page, score, snippet.

    Pages outside any section stand for themselves. Up to max_results per document (or over all documents if not per_spec),
    by score, then page.
    """
    hits = score_pages(pages.select("spec_id", "page", "section", "text", *[c for c in ("norm",) if c in pages.columns]), query).drop("text")
    group = F.coalesce(F.nullif("section", F.lit("")), F.concat(F.lit("page:"), F.col("page").cast("string")))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("spec_id", group).orderBy(F.desc("score"), "page"))).where("n = 1").drop("n")
    if max_results is None:
        return best
    if not per_spec:
        return best.orderBy(F.desc("score"), "page", "spec_id").limit(max_results)
    return best.withColumn("n", F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc("score"), "page"))).where(F.col("n") <= max_results).drop("n")


def with_titles(hits: DataFrame, secs: DataFrame) -> DataFrame:
    """Hits with the title of their section, '' where there is none."""
    titles = secs.groupBy("spec_id", "section").agg(F.max_by("title", "ord").alias("title"))
    return hits.join(titles, ["spec_id", "section"], "left").withColumn("title", F.coalesce("title", F.lit("")))

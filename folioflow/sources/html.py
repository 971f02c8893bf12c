"""Content elements of web pages whose tags need not be well-formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is no text, and the tags that begin or end a block.
NO_TEXT = r"(?is)<(script|style|head|nav)\b[^>]*>.*?</\1\s*>"
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre")


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, elem_ord, tag, type, level, text) of each block of a page in order.

    The page is cut at each ``<``; a block tag that opens begins a block, and the next block tag, opening or closing, ends it.
    Other tags are dropped and their text kept. Blank blocks are left out.
    """
    cuts = F.split(F.regexp_replace(html, NO_TEXT, ""), "<", -1)
    rows = pages.select(key, F.posexplode(cuts).alias("n", "cut")).where("n > 0")
    tag = F.lower(F.regexp_extract("cut", "^(/?[A-Za-z][A-Za-z0-9]*)", 1))
    rows = rows.select(key, "n", tag.alias("tag"), F.regexp_replace("cut", "^[^>]*>", "").alias("text"))
    edge = F.regexp_replace("tag", "^/", "").isin(*BLOCKS)
    run = F.sum(edge.cast("int")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    blocks = rows.withColumn("run", run).where("run > 0").groupBy(key, "run").agg(F.min_by("tag", "n").alias("tag"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))
    text = F.trim(F.regexp_replace(F.array_join("p.text", ""), "\\s+", " "))
    kept = blocks.select(key, "run", "tag", text.alias("text")).where((F.col("text") != "") & ~F.startswith("tag", F.lit("/")))
    kind = F.when(F.startswith("tag", F.lit("h")), "heading").when(F.col("tag") == "li", "list").when(F.col("tag") == "pre", "code").otherwise("paragraph")
    level = F.when(F.startswith("tag", F.lit("h")), F.substring("tag", 2, 1).cast("int"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("run"))
    return kept.select(key, number.alias("elem_ord"), "tag", kind.alias("type"), level.alias("level"), "text")

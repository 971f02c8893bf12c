"""Tables of a section: with captions, put together across pages, or read from spaced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import spans

# How a paragraph before a table names it, and how a caption of a spaced table looks.
CAPTION = f"^Table{tx.WS}+[0-9]+"
TEXT_CAPTION = f"^(Table{tx.WS}+[0-9]+){tx.WS}*[—–-]{tx.WS}*(.+)"
KEY = ["spec_id", "section"]


def tagged_tables(content: DataFrame) -> DataFrame:
    """Tables of ``content`` (spec_id, section, elem_ord, type, text, headers, rows): spec_id, section, index, caption, headers, rows.

    The paragraph right before a table is its caption if it says so. A table without a caption whose headers equal those of the
    table before goes on with it, whatever lies between.
    """
    # what stood right before, and the headers of the table before: structs, as a value that is null hides none before it
    caption = F.struct(F.when((F.col("type") == "paragraph") & F.rlike("text", F.lit(CAPTION)), F.col("text")).alias("text"))
    table = F.col("type") == "table"
    told = spans.last_before(content.select(*KEY, "elem_ord", "type", "text", "headers", "rows"), KEY, "elem_ord", {"before": caption, "last": F.when(table, F.struct("headers"))})
    found = told.where(table).withColumn("caption", F.col("before.text"))
    again = F.col("caption").isNull() & (F.size("headers") > 0) & F.coalesce(F.col("last.headers") == F.col("headers"), F.lit(False))
    numbered = spans.count_so_far(found.select(*KEY, "elem_ord", "caption", "headers", "rows", again.alias("again")), KEY, "elem_ord", "nth", ~F.col("again"))
    whole = numbered.groupBy(*KEY, (F.col("nth") - 1).alias("index")).agg(F.array_sort(F.collect_list(F.struct("elem_ord", "caption", "headers", "rows"))).alias("p"))
    return whole.select(*KEY, F.col("index").cast("int").alias("index"), F.get("p.caption", F.lit(0)).alias("caption"), F.get("p.headers", F.lit(0)).alias("headers"), F.flatten("p.rows").alias("rows"))


def cells(text: Column) -> Column:
    """A line's cells: split at tabs, or at two or more spaces where there is none; trimmed, empty ones left out."""
    parts = F.when(text.contains("\t"), F.split(text, "\t", -1)).otherwise(F.split(text, f"{tx.WS}{{2,}}", -1))
    return F.filter(F.transform(parts, tx.trim), lambda c: c != "")


def text_tables(content: DataFrame) -> DataFrame:
    """Tables written as paragraphs: a caption, then paragraphs of two or more cells each, the first of which is the header.

    A table ends before what is no paragraph, is over 300 characters without a tab, or has fewer than two cells.
    """
    is_caption = (F.col("type") == "paragraph") & F.rlike("text", F.lit(TEXT_CAPTION))
    rows = content.select(*KEY, "elem_ord", "type", "text", F.coalesce(is_caption, F.lit(False)).alias("is_caption"))
    marked = spans.count_so_far(rows, KEY, "elem_ord", "table", F.col("is_caption")).where("table > 0")
    marked = marked.withColumn("cells", F.when(F.col("type") == "paragraph", cells(F.col("text"))))
    bad = ~F.col("is_caption") & ((F.col("type") != "paragraph") | ((F.length("text") > 300) & ~F.col("text").contains("\t")) | (F.size("cells") < 2))
    marked = marked.withColumn("bad", F.coalesce(bad, F.lit(True)))
    # a table is over at the first such element: its place is a minimum, whatever follows
    stops = marked.groupBy(*KEY, "table").agg(F.min(F.when(F.col("bad"), F.col("elem_ord"))).alias("stop"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*KEY, "table")]
    kept = marked.alias("m").join(stops.alias("s"), same).where(F.col("stop").isNull() | (F.col("elem_ord") < F.col("stop"))).select("m.*")
    whole = kept.groupBy(*KEY, "table").agg(
        F.max(F.when(F.col("is_caption"), F.col("text"))).alias("caption"),
        F.array_sort(F.collect_list(F.when(~F.col("is_caption"), F.struct("elem_ord", "cells")))).alias("p"),
    ).where(F.size("p") > 0)
    index = spans.count_so_far(whole, KEY, "table", "nth", F.lit(True))
    return index.select(*KEY, (F.col("nth") - 1).cast("int").alias("index"), "caption", F.get("p.cells", F.lit(0)).alias("headers"), F.slice("p.cells", 2, F.size("p")).alias("rows"))


def section_tables(content: DataFrame) -> DataFrame:
    """The tagged tables of each section, or its spaced ones where it has none that are tagged."""
    tagged = tagged_tables(content)
    return tagged.unionByName(text_tables(content).join(tagged.select(*KEY).distinct(), KEY, "left_anti"))

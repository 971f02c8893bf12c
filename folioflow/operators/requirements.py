"""Sentences that state requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.sources import shared

# The keywords, longer ones first.
KEYWORDS = ("shall not", "should not", "shall", "should", "may")
#: Between a level and its sentence; taken out of texts.
_MARK = "\x01"
#: Where a sentence may begin: behind a stop that white space follows and no digit precedes. It may end at any stop that white space follows.
_BEGINS = f"(?<=(?<![0-9])[.!?])(?={tx.WS})"
_ENDS = f"(?<=[.!?])(?={tx.WS})"
#: Elements of a section are numbered in spans of so many places, so that no task sorts a whole section.
SPAN = 1 << 16


def texts(content: DataFrame) -> DataFrame:
    """What is searched for requirements: paragraphs, notes and list items, as (spec_id, section, elem_ord, item_ord, text)."""
    keep = content.where(F.col("type").isin("paragraph", "note", "list"))
    parts = F.when(F.col("type") == "list", F.col("items")).otherwise(F.array("text"))
    return keep.select("spec_id", "section", "elem_ord", F.posexplode(parts).alias("item_ord", "text"))


def _pattern(keywords: tuple[str, ...]) -> str:
    return f"(?i){tx.BEFORE_WORD}({'|'.join(keywords)}){tx.AFTER_WORD}"


def _sentences(text: Column, keywords: tuple[str, ...]) -> Column:
    """level, mark and sentence of each keyword of a text, in order, each once.

    The text is cut where sentences may begin, and such a part where sentences may end: the sentence of a keyword is the part up
    to the end of the keyword's piece. Every step is linear in the text.
    """
    pattern = _pattern(keywords)
    parts = F.filter(F.split(F.replace(text, F.lit(_MARK), F.lit("")), _BEGINS, -1), lambda part: F.rlike(part, F.lit(pattern)))

    def of_part(part: Column) -> Column:
        def of_piece(pieces: Column, i: Column) -> Column:
            sentence = tx.trim(F.array_join(F.slice(pieces, 1, i + 1), ""))
            levels = F.array_distinct(F.regexp_extract_all(F.lower(F.get(pieces, i)), F.lit(pattern), F.lit(1)))
            return F.transform(levels, lambda level: F.concat(level, F.lit(_MARK), sentence))

        pieces = F.split(part, _ENDS, -1)
        return F.flatten(F.transform(pieces, lambda _, i: of_piece(pieces, i)))

    return F.array_distinct(F.flatten(F.transform(parts, of_part)))


def found(content: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Requirements of ``content`` without numbers: spec_id, section, elem_ord, item_ord, n, level, text."""
    rows = texts(content).where(F.rlike("text", F.lit(_pattern(keywords))))
    each = rows.select("spec_id", "section", "elem_ord", "item_ord", F.posexplode(_sentences(F.col("text"), keywords)).alias("n", "m"))
    return each.select("spec_id", "section", "elem_ord", "item_ord", "n", F.substring_index("m", _MARK, 1).alias("level"), F.substring_index("m", _MARK, -1).alias("text"))


def extract(content: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """Requirements of ``content`` (spec_id, section, elem_ord, type, text, items): spec_id, section, id, level, text, and where they stand.

    A sentence counts once per level within a paragraph, note or item; ids number the requirements of a section in order.
    Sentences are cut once: they are written before they are numbered.
    """
    rows = numbered(shared.written(found(content, keywords), "requirements"), ["elem_ord", "item_ord", "n"])
    return rows.select("spec_id", "section", F.concat_ws("-", F.lit("R"), "section", F.col("number").cast("string")).alias("id"), "level", "text", "elem_ord", "item_ord", "number")


def numbered(rows: DataFrame, order: list[str], group: tuple[str, ...] = ("spec_id", "section")) -> DataFrame:
    """``rows`` with their ``number`` from 1 within their group, by ``order``, whose first column is a whole number.

    Rows are numbered within spans of that column; what lies before a span is a running sum of counts, one per span.
    """
    keys = [*group, "span"]
    spanned = rows.withColumn("span", F.floor(F.col(order[0]) / SPAN))
    behind = Window.partitionBy(*group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = spanned.groupBy(*keys).agg(F.count("*").alias("here")).select(*keys, F.coalesce(F.sum("here").over(behind), F.lit(0)).alias("before"))
    placed = spanned.withColumn("inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return placed.alias("a").join(before.alias("b"), same).select("a.*", (F.col("before") + F.col("inside")).cast("int").alias("number")).drop("span", "inside")


def statistics(requirements: DataFrame) -> DataFrame:
    """How many requirements (of :func:`found` or :func:`extract`) of each level there are, levels without any left out."""
    return requirements.groupBy("spec_id", "level").agg(F.count("*").alias("n"))

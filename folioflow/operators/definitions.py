"""Terms and definitions of a terminology section.

What an element means hangs on those before it, but not on all of them: a marker sets everything back, and between two markers
whether a term is open, and has text, follows from how many likely terms came since the last plain text. So elements are cut at
markers, which are counted by spans, and each stretch is worked out by running counts of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import spans
from folioflow.operators.requirements import numbered


def extract(content: DataFrame, root: str = "3") -> DataFrame:
    """Definitions (spec_id, number, term, definition, section, notes, source) of ``content`` (spec_id, elem_ord, type, text, label, items), the section ``root`` of each document.

    An element that is just a number below the root, or a heading that begins with one, opens a definition; so does a paragraph
    that looks like a term once the one before has text. Further paragraphs are its text, notes its notes, ``[SOURCE: ...]`` its
    source. A heading of a later section ends it. Definitions are numbered in order, whatever their own numbers are. A stretch
    between two markers is one task's work, and streams through it.
    """
    dot = re.escape(root) + "\\."
    marks = f"^{dot}[0-9]+"
    later = f"^[{int(root) + 1}-9]{tx.WS}|^[1-9][0-9]{tx.WS}" if root.isdigit() and len(root) == 1 and root < "9" else f"^[1-9][0-9]{tx.WS}"
    t = tx.trim(F.coalesce("text", F.lit("")))
    heading, paragraph = F.col("type") == "heading", F.col("type") == "paragraph"
    parts = F.filter(F.transform(F.split(F.array_join("items", "\n"), "\n", -1), tx.trim), lambda p: p != "")
    numbers = (F.col("type") == "list") & F.forall(parts, lambda p: F.rlike(p, F.lit(marks + "\\z")))
    marker = (paragraph & F.rlike(t, F.lit(marks + "\\z"))) | (heading & F.rlike(t, F.lit(f"{marks}{tx.WS}")))
    skip = (heading & F.startswith("text", F.lit(root + " "))) | numbers
    what = (
        F.when(heading & F.startswith("text", F.lit(root + " ")), "skip")
        .when(heading & F.rlike("text", F.lit(later)), "end")
        .when(skip, "skip")
        .when(marker, "mark")
        .when(paragraph, "text")
        .when(F.col("type") == "note", "note")
        .otherwise("skip")
    )
    named = F.when(heading, tx.trim(F.regexp_replace(t, f"{marks}{tx.WS}+", ""))).otherwise("")
    body = F.when(F.col("type") == "note", F.concat("label", F.lit(": "), "text")).when(F.col("type") == "heading", named).otherwise(t)
    source = tx.trim(F.regexp_extract(t, f"\\[SOURCE:{tx.WS}*([^\\]]+)\\]", 1))
    # a marker that is a paragraph has no term text of its own
    body = F.when((what == "mark") & F.rlike(body, F.lit(marks + "\\z")), "").otherwise(body)
    likely = tx.is_likely_term(t) & (what == "text")
    rows = content.select("spec_id", F.col("elem_ord").cast("bigint").alias("at"), what.alias("what"), body.alias("text"), likely.alias("likely"), F.nullif(source, F.lit("")).alias("source")).where("what <> 'skip'")
    ends = rows.where("what = 'end'").groupBy("spec_id").agg(F.min("at").alias("stop"))
    rows = rows.alias("r").join(ends.alias("e"), F.col("r.spec_id").eqNullSafe(F.col("e.spec_id")), "left").where(F.col("stop").isNull() | (F.col("at") < F.col("stop"))).select("r.*")

    # stretches: how many markers came before, by spans
    mark = F.col("what") == "mark"
    rows = spans.count_so_far(rows, ["spec_id"], "at", "stretch", mark)

    # within a stretch: a likely term opens one where none is open; the first text behind a term is its text, and later likely terms
    # open the next. So behind plain text, or behind a term, likely terms are text and term in turn.
    own = Window.partitionBy("spec_id", "stretch").orderBy("at")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    terms, plain = F.count_if("likely").over(run), (F.col("what") == "text") & ~F.col("likely")
    named = F.max(mark & (F.col("text") != "")).over(run)
    rows = rows.select("*", terms.alias("terms"), F.coalesce(named, F.lit(False)).alias("named"))
    is_open = F.col("named") | (F.col("terms") - F.col("likely").cast("int") > 0)  # before this element
    rows = rows.withColumn("open", is_open).withColumn("reset", F.last(F.when(plain & is_open, F.col("terms")), ignorenulls=True).over(run))
    since = F.when(F.col("reset").isNotNull(), F.col("terms") - F.col("reset")).when(F.col("named"), F.col("terms") + 1).otherwise(F.col("terms"))
    # odd: a term without text is open; even: one with text, or, before the first, none
    rows = rows.withColumn("fresh", since % 2 == 1)
    opens = (mark & (F.col("text") != "")) | (F.col("likely") & F.col("fresh"))
    rows = rows.withColumn("opens", opens).withColumn("nth", F.count_if("opens").over(run)).where("nth > 0")
    said, noted = (F.col("what") == "text") & ~F.col("opens"), F.col("what") == "note"

    def listed(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, F.struct("at", "text"))))["text"]

    made = rows.groupBy("spec_id", "stretch", "nth").agg(
        F.min("at").alias("at"), F.min_by("text", "at").alias("term"), F.count_if(said).alias("n"), listed(said).alias("texts"), listed(noted).alias("notes"),
        F.max_by(F.when(said, F.col("source")), F.when(said & F.col("source").isNotNull(), F.col("at"))).alias("source"),
    ).where("n > 0")
    made = numbered(made, ["at"], ("spec_id",))
    return made.select(
        "spec_id", "number", "term", tx.trim(F.array_join("texts", " ")).alias("definition"), F.concat(F.lit(root + "."), F.col("number").cast("string")).alias("section"),
        F.when(F.size("notes") > 0, F.col("notes")).alias("notes"), "source",
    )


def matching(definitions: DataFrame, term: str | None = None) -> DataFrame:
    """Definitions whose term or text has ``term`` in it, in any case."""
    if not term:
        return definitions
    low = term.lower()
    return definitions.where(F.lower("term").contains(low) | F.lower("definition").contains(low))

"""From web pages to the canonical tables: nodes of a role tree and marked text, by Spark expressions alone.

A page is cut at each tag. Tags that hold others (lists, tables, sections: BRACKETS) are brackets, whose depth is a running sum;
a closing tag that nothing is open for is left out. Between two brackets of one depth stand items, rows, cells and text blocks,
which may lack their end tags: each has a rank (RANKS), and ends at the next tag whose rank is no higher; a text block ends
at a bracket too. So what a tag or a
piece of text hangs on is the last open tag of a lower rank at its depth, or else the bracket around it: one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources import canonical as tables

# What is no text; brackets and the others with their roles, an end tag of which may be missing; entities.
NO_TEXT = r"(?is)<!--.*?-->|<(script|style|head)\b[^>]*>.*?</\1\s*>"
BRACKETS = {
    "html": "Document", "body": "Part", "div": "Div", "section": "Sect", "article": "Art", "main": "Part", "blockquote": "BlockQuote", "form": "Form", "figure": "Figure",
    "ul": "L", "ol": "L", "table": "Table", "nav": "Artifact", "header": "Artifact", "footer": "Artifact", "aside": "Artifact",
}
RANKS = {"thead": 1, "tbody": 1, "tfoot": 1, "li": 1, "tr": 2, "td": 3, "th": 3, "p": 4, "pre": 4, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4}
ROLES = {"thead": "THead", "tbody": "TBody", "tfoot": "TFoot", "li": "LI", "tr": "TR", "td": "TD", "th": "TH", "p": "P", "pre": "Code", **{f"h{i}": f"H{i}" for i in range(1, 7)}}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": chr(0xA0), "copy": chr(0xA9), "reg": chr(0xAE), "middot": chr(0xB7), "laquo": chr(0xAB), "raquo": chr(0xBB), "ndash": chr(0x2013), "mdash": chr(0x2014), "lsquo": chr(0x2018), "rsquo": chr(0x2019), "ldquo": chr(0x201C), "rdquo": chr(0x201D), "bull": chr(0x2022), "hellip": chr(0x2026), "euro": chr(0x20AC)}
#: Between the top of a page and the deepest rank.
_RANKS = range(5)
_KEY = ["spec_id", "page"]


def _of(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def decoded(text: Column) -> Column:
    """Text with its entities resolved: those of ENTITIES, and numbers of characters. What is no entity stays."""
    parts = F.split(text, "&", -1)

    def of_part(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);", 1)
        number = F.when(F.rlike(name, F.lit("^#[0-9]")), F.substring(name, 2, 7).cast("long")).when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 6), 16, 10).cast("long"))
        sound = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(_of(ENTITIES, name))
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), of_part), ""))).otherwise(text)


def tags(pages: DataFrame) -> DataFrame:
    """The tags of ``pages`` (spec_id, page, html) in order: spec_id, page, tagged (is there any), n, tag, opens, text (what follows, its white space as single spaces).

    What comes before the first tag has n 0 and no tag. A tag that the page's end cuts off is left out.
    """
    cuts = F.split(F.regexp_replace("html", NO_TEXT, " "), "<", -1)
    # what is said of a whole page is worked out before its tags are rows, which would work it out again and carry the page each
    whole = pages.select(*_KEY, (F.size(cuts) > 1).alias("tagged"), cuts.alias("cuts"))
    rows = whole.select(*_KEY, "tagged", F.posexplode("cuts").alias("n", "cut")).where((F.col("n") == 0) | F.col("cut").contains(">"))
    name = F.nullif(F.lower(F.regexp_extract("cut", "^/?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    after = F.when(F.col("n") == 0, F.col("cut")).otherwise(F.regexp_replace("cut", "^[^>]*>", ""))
    tag = F.when(F.col("n") > 0, name)
    opens = ~F.startswith("cut", F.lit("/")) & ~F.rlike("cut", F.lit("^[^>]*/>"))
    return rows.select(*_KEY, "tagged", "n", tag.alias("tag"), opens.alias("opens"), decoded(F.regexp_replace(after, "[ \\t\\n\\f\\r]+", " ")).alias("text"))


def _nodes_of(pages: DataFrame) -> DataFrame:
    """What hangs where (spec_id, page, tagged, n, leaf, node_id, parent_id, role, text): a row for each tag that makes a node and each piece of text."""
    every = tags(pages)
    bracket, rank = _of(BRACKETS, F.col("tag")), _of(RANKS, F.col("tag"))
    every = every.withColumn("bracket", bracket).withColumn("rank", rank)
    # an end tag counts if one of its name is open: running sums never fall below their least so far
    run = Window.partitionBy(*_KEY, "tag").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("bracket").isNotNull(), F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)
    every = every.withColumn("turn", turn).withColumn("sum", F.sum("turn").over(run))
    before = Window.partitionBy(*_KEY, "tag").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    least = F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0)))
    every = every.withColumn("turn", F.when((F.col("turn") < 0) & (F.col("sum") < least), 0).otherwise(F.col("turn")))
    depth = F.sum("turn").over(Window.partitionBy(*_KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("depth", depth)

    # events at a depth: a bracket ends a text block outside and hangs where that did, and begins anew inside; text comes behind its tag;
    # ``opens`` says that what follows at this depth hangs on it, ``role`` that it is a node
    node, turn = F.col("n").cast("bigint") * 2 + 2, F.col("turn")
    none = F.lit(None)

    def event(step: int, at: Column, rank: Column, opens: Column, role: Column, text: Column = none) -> Column:
        return F.struct(F.lit(step).alias("step"), at.alias("depth"), rank.cast("int").alias("rank"), opens.alias("opens"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    block, child, inside, yes, no = F.lit(4), F.lit(5), F.lit(0), F.lit(True), F.lit(False)
    inline = (F.col("n") > 0) & F.col("bracket").isNull() & F.col("rank").isNull()  # a space between marked-up words is one of the text
    role = F.coalesce("bracket", _of(ROLES, F.col("tag")))
    made = F.array(
        F.when(F.col("n") == 0, event(-1, F.lit(0).cast("long"), inside, yes, F.lit("Root"))),
        F.when(turn > 0, event(0, F.col("depth") - 1, block, no, role)),
        F.when(turn > 0, event(1, F.col("depth"), inside, yes, none)),
        F.when(turn < 0, event(1, F.col("depth") + 1, inside, no, none)),
        F.when(F.col("rank").isNotNull(), event(0, F.col("depth"), F.col("rank"), F.col("opens"), F.when(F.col("opens"), role))),
        F.when((F.trim("text") != "") | ((F.col("text") != "") & inline), event(2, F.col("depth"), child, no, none, F.col("text"))),
    )
    events = every.select(*_KEY, "tagged", "n", node.alias("node_id"), F.explode(F.array_compact(made)).alias("e")).select(*_KEY, "tagged", "n", "node_id", "e.*")
    so_far = Window.partitionBy(*_KEY, "depth").orderBy("n", "step").rowsBetween(Window.unboundedPreceding, -1)
    open_at = [F.last(F.when(F.col("rank") <= q, F.struct(F.when(F.col("opens") & (F.col("rank") == q), F.col("node_id")).alias("id"))), ignorenulls=True).over(so_far)["id"] for q in _RANKS]
    held = events.select("*", *[c.alias(f"open{q}") for q, c in enumerate(open_at)])
    above = F.coalesce(*[F.when(F.col("rank") > q, F.col(f"open{q}")) for q in reversed(_RANKS)])
    is_text = F.col("text").isNotNull()
    return held.where(is_text | F.col("role").isNotNull()).select(*_KEY, "tagged", "n", is_text.alias("leaf"), (F.col("node_id") + is_text.cast("int")).alias("node_id"), above.alias("parent_id"), "role", "text")


def canonical(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``struct_nodes`` and ``text_items`` (see canonical.SCHEMAS) of ``pages`` (spec_id, page, html).

    Each piece of text is a leaf with a piece of its own; a block without text has no leaf. Navigation, headers and footers are
    artifacts; scripts, styles, comments and the head are left out; tags that only mark up words are as if they were not there.
    Spaces on both sides of such a tag both stay.
    A page has a root of its own; one without tags has no nodes, so that all its text is a paragraph, and one that is null has nothing. Repeated pages are one page.
    """
    found = _nodes_of(pages.select("spec_id", F.col("page").cast("int").alias("page"), "html").dropDuplicates(_KEY))
    content_id = F.when(F.col("leaf"), F.concat(F.lit("t"), F.col("n").cast("string")))
    nodes = found.where("tagged").select(*_KEY, "node_id", "parent_id", F.col("node_id").cast("int").alias("sib_ord"), "role", content_id.alias("content_id"))
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind")) for i, kind in enumerate(("begin_props", "text", "end"))])
    items = found.where("leaf").select(*_KEY, "n", "text", content_id.alias("id"), F.explode(pieces).alias("e"))
    said = F.col("e.kind") == "text"
    items = items.select(*_KEY, (F.col("n") * 3 + F.col("e.i")).cast("int").alias("seq"), F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "begin_props", F.col("id")).alias("content_id"), F.when(said, F.col("text")).alias("str"), F.when(said, F.lit(False)).alias("has_eol"))
    return nodes.to(_schema("struct_nodes", nodes)), items.to(_schema("text_items", items))


def _schema(name: str, df: DataFrame):  # noqa: ANN202
    return df.sparkSession.createDataFrame([], tables.SCHEMAS[name]).schema


#: Headings are lined up in spans of so many pages, so that no task sorts those of a whole document.
SPAN = 4096


def outline_entries(headings: DataFrame) -> DataFrame:
    """``outline_entries`` of documents that bring none, from ``headings`` (spec_id, page, elem_ord, level, text): a heading hangs on the last one before it of a lower level.

    entry_id and sib_ord number a document's headings in order. Of the headings before one the nearest of a lower level is the
    latest of the last ones of each lower level; these are found span by span, with what the spans before leave. Headings
    without a level or text are left out.
    """
    from folioflow.operators.requirements import numbered

    rows = headings.where(F.col("level").isNotNull() & F.col("text").isNotNull()).select("spec_id", "page", "elem_ord", F.col("level").cast("int").alias("level"), F.col("text").alias("title"))
    rows = numbered(rows, ["page", "elem_ord"], ("spec_id",)).withColumn("span", F.floor(F.col("number") / SPAN))
    levels = range(1, 7)
    last = {q: F.max(F.when(F.col("level") == q, F.col("number"))) for q in levels}
    left = rows.groupBy("spec_id", "span").agg(*[last[q].alias(f"here{q}") for q in levels])
    behind = Window.partitionBy("spec_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("spec_id", "span", *[F.max(f"here{q}").over(behind).alias(f"left{q}") for q in levels])
    inside = Window.partitionBy("spec_id", "span").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[last[q].over(inside).alias(f"in{q}") for q in levels]).alias("r")
    joined = rows.join(left.alias("l"), F.col("r.spec_id").eqNullSafe(F.col("l.spec_id")) & (F.col("r.span") == F.col("l.span"))).drop(F.col("l.spec_id"), F.col("l.span"))
    parent = F.array_max(F.array(*[F.when(F.col("level") > q, F.greatest(f"in{q}", f"left{q}")) for q in levels]))
    return joined.select("spec_id", F.col("number").cast("bigint").alias("entry_id"), parent.cast("bigint").alias("parent_id"), F.col("number").alias("sib_ord"), "title", F.col("page").cast("int").alias("page"))


def load_content(pages: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Writes ``struct_nodes`` and ``text_items`` of ``pages`` (spec_id, page, html) to ``folder``, and reads them; walks of the nodes read them level by level."""
    nodes, items = canonical(pages)
    tables.write({"struct_nodes": nodes, "text_items": items}, folder)
    return tables.read(pages.sparkSession, folder, ("struct_nodes", "text_items"))


def load(pages: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Writes the canonical tables but ``specs`` that ``pages`` (spec_id, page, html) give to ``folder``, and reads them: nodes, items, the outline of the headings, page counts."""
    from folioflow.operators import content

    made = load_content(pages, folder)
    headings = content.page_elements(*[tables.of_spec(made[t], None) for t in ("struct_nodes", "text_items")]).where("type = 'heading'")
    stats = pages.groupBy("spec_id").agg(F.max("page").cast("int").alias("total_pages"))
    tables.write({"outline_entries": outline_entries(headings), "doc_stats": stats}, folder)
    return made | tables.read(pages.sparkSession, folder, ("outline_entries", "doc_stats"))

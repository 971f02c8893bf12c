"""Tagged page content: from role trees and marked text to headings, paragraphs, lists, tables, notes and code.

Inputs: struct_nodes (spec_id, page, node_id, parent_id, sib_ord, role, content_id; a node with a content_id is a leaf) and
text_items (spec_id, page, seq, kind, content_id, str, has_eol). One recursive query gives every node its path and the block it
belongs to; what follows groups leaves by block, item or cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators.recursion import recursive

MAX_LEVELS = 64
PAGE = ["spec_id", "page"]
AT = [*PAGE, "block_path", "block_role"]
CONTENT = ["spec_id", "page", "elem_ord", "type", "level", "text", "label", "items", "headers", "rows"]
# Roles that make a block of their own, and how a paragraph says that it is a note.
BLOCKS = "role RLIKE '^H[1-6]?\\\\z' OR role IN ('P', 'L', 'Table', 'Code')"
NOTE = f"(?i)^(NOTE{tx.WS}*[0-9]*|EXAMPLE{tx.WS}*[0-9]*){tx.WS}+"


def _line(item_text: str = "str") -> F.Column:
    return F.concat(F.coalesce(F.col(item_text), F.lit("")), F.when(F.col("has_eol"), "\n").otherwise(""))


def marked_text(items: DataFrame) -> DataFrame:
    """The text of each marked piece (spec_id, page, content_id, text).

    A piece opens with a begin event that names an id and closes with the next such event or any end event; text outside is
    left out. Of pieces with one id the last that has a text item stays.
    """
    run = Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    event = ((F.col("kind") == "begin_props") & F.col("content_id").isNotNull()) | (F.col("kind") == "end")
    marked = items.where(event | (F.col("kind") == "text")).withColumn("run", F.sum(event.cast("int")).over(run))
    opened = F.first(F.when(event, F.struct(F.when(F.col("kind") == "begin_props", F.col("content_id")).alias("id"))), ignorenulls=True)
    texts = marked.withColumn("id", opened.over(Window.partitionBy(*PAGE, "run"))["id"]).where((F.col("kind") == "text") & F.col("id").isNotNull())
    whole = texts.groupBy(*PAGE, "id", "run").agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), _line().alias("s")))).alias("p"))
    last = whole.groupBy(*PAGE, "id").agg(F.max_by("p", "run").alias("p"))
    return last.select(*PAGE, F.col("id").alias("content_id"), F.array_join("p.s", "").alias("text"))


def _walk(nodes: DataFrame) -> DataFrame:
    """Nodes that count, with path, roles and sub-paths on the way down, and the path and role of their block. Artifacts are left out with all below."""
    block = f"CASE WHEN {BLOCKS} THEN true ELSE false END".replace("role", "c.role")
    return recursive(
        nodes.where("role IS NULL OR role <> 'Artifact'"),
        f"""
        WITH RECURSIVE walk (spec_id, page, node_id, role, content_id, path, roles, block_path, block_role, live) MAX RECURSION LEVEL {MAX_LEVELS} AS (
          SELECT spec_id, page, node_id, role, content_id, array(sib_ord), array(coalesce(role, '')), CAST(NULL AS ARRAY<INT>), CAST(NULL AS STRING), parent_id IS NULL
          FROM {{rows}}
          UNION ALL
          SELECT /*+ MERGE(c) */ c.spec_id, c.page, c.node_id, c.role, c.content_id, array_append(w.path, c.sib_ord), array_append(w.roles, coalesce(c.role, '')),
            coalesce(w.block_path, CASE WHEN {block} THEN array_append(w.path, c.sib_ord) END),
            coalesce(w.block_role, CASE WHEN {block} THEN c.role END), true
          FROM walk w JOIN {{rows}} c ON w.live AND c.spec_id = w.spec_id AND c.page = w.page AND c.parent_id = w.node_id)
        SELECT *, slice(roles, size(block_path) + 1, 64) AS below, slice(path, size(block_path) + 1, 64) AS sub FROM walk WHERE live AND block_path IS NOT NULL""",
    )


def _pieces(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """What blocks are made of (page, block, tr, td, is_cell, is_row, in_head, all_th, text), from one walk of the nodes.

    A list's piece is an item, with its place as tr; a table's is a cell, or a row's mark, with td null; another block's is the
    whole. Texts of leaves are put together in path order.
    """
    table, list_ = F.col("block_role") == "Table", F.col("block_role") == "L"
    below, sub = (lambda i: F.get("below", F.lit(i))), (lambda i: F.get("sub", F.lit(i)))
    depth = F.when(table & (below(0) == "TR"), 1).when(table & below(0).isin("THead", "TBody", "TFoot") & (below(1) == "TR"), 2)
    leaf = F.col("content_id").isNotNull()
    of_item = list_ & (below(0) == "LI") & (F.coalesce(below(1), F.lit("")) != "Lbl")
    rows = _walk(nodes).withColumn("depth", depth)
    size = F.size("below")
    is_row, is_cell = ~leaf & (size == F.col("depth")), ~leaf & (size == F.col("depth") + 1)
    in_cell = leaf & (size > F.col("depth") + 1)
    wanted = F.when(table, is_row | is_cell | in_cell).when(list_, leaf & of_item).otherwise(leaf)
    rows = rows.where(F.coalesce(wanted, F.lit(False)))
    rows = rows.join(marked_text(items), [*PAGE, "content_id"], "left").where(F.col("content_id").isNull() | F.col("text").isNotNull())
    rows = rows.select(
        *AT,
        F.when(table, F.slice("sub", 1, F.coalesce("depth", F.lit(1)))).when(list_, F.slice("sub", 1, 1)).alias("tr"),
        F.when(table & ~is_row, F.get("sub", "depth")).alias("td"),
        is_cell.alias("is_cell"), is_row.alias("is_row"), (below(0) == "THead").alias("in_head"),
        F.when(is_cell, (F.col("role") == "TH").cast("int")).alias("th"),
        F.when(leaf, F.struct("path", "text")).alias("part"),
    )
    pieces = rows.groupBy(*AT, "tr", "td").agg(F.bool_or("is_cell").alias("is_cell"), F.bool_or("is_row").alias("is_row"), F.bool_or("in_head").alias("in_head"), F.min("th").alias("th"), F.array_sort(F.collect_list("part")).alias("p"))
    return pieces.withColumn("text", tx.trim(F.array_join("p.text", ""))).drop("p")


def page_elements(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """The content elements of each page in order (see CONTENT). Pages without nodes are one paragraph of all their text.

    Blank elements are left out; text right under a container is too. A list has the items that are LI right below it, without
    the labels right below those. A table's first non-empty THead row is its header, or else its first row if that has only TH
    cells; empty rows are left out.
    """
    shown = F.col("is_cell") | (F.col("block_role") != "Table")
    row = F.struct("td", F.coalesce("text", F.lit("")).alias("text"))
    # by row of a table, item of a list, or whole block
    lines = _pieces(nodes, items).groupBy(*AT, "tr").agg(F.array_sort(F.collect_list(F.when(shown, row))).alias("c"), F.bool_or("in_head").alias("in_head"), F.min("th").alias("th"), F.bool_or("is_row").alias("is_row"))
    line = F.struct((~F.coalesce("in_head", F.lit(False))).alias("later"), "tr", F.col("c.text").alias("cells"), F.coalesce("in_head", F.lit(False)).alias("in_head"), (F.coalesce("th", F.lit(0)) == 1).alias("all_th"), F.coalesce("is_row", F.lit(False)).alias("is_row"))
    blocks = lines.groupBy(*AT).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    table, list_ = F.col("block_role") == "Table", F.col("block_role") == "L"
    filled = F.filter("lines", lambda x: F.size(x.cells) > 0)
    # a direct or body row can be the header only if it is the table's first row, even where that has no cells
    first_tr = F.array_min(F.transform(F.filter("lines", lambda x: ~x.in_head & x.is_row), lambda x: x.tr))
    blocks = blocks.select(*AT, "lines", filled.alias("filled"), first_tr.alias("first_tr"))
    top = F.get("filled", F.lit(0))
    # lines of a THead come first, so the first of all is one of them if there is any
    headed = F.coalesce(top.in_head | (top.all_th & (top.tr == F.col("first_tr"))), F.lit(False))
    empty = F.array().cast("array<string>")
    rest = F.transform(F.slice("filled", F.when(headed, 2).otherwise(1), F.size("filled")), lambda x: x.cells)
    text = F.get(F.get("lines", F.lit(0)).cells, F.lit(0))
    items_ = F.filter(F.transform("lines", lambda x: F.get(x.cells, F.lit(0))), lambda t: t != "")

    note = F.regexp_extract(text, NOTE, 1)
    noted = (F.col("block_role") == "P") & (note != "")
    heading = F.startswith("block_role", F.lit("H"))
    kind = F.when(table, "table").when(list_, "list").when(heading, "heading").when(F.col("block_role") == "Code", "code").when(noted, "note").otherwise("paragraph")
    tagged = blocks.where(F.when(table, F.size("filled") > 0).when(list_, F.size(items_) > 0).otherwise(text != "")).select(
        *PAGE,
        F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_path")).alias("elem_ord"),
        kind.alias("type"),
        F.when(F.col("block_role") == "H", 3).when(heading, F.substring("block_role", 2, 1).cast("int")).alias("level"),
        F.when(~table & ~list_, F.when(noted, tx.trim(F.regexp_replace(text, NOTE, ""))).otherwise(text)).alias("text"),
        F.when(noted, note).alias("label"),
        F.when(list_, items_).alias("items"),
        F.when(table, F.when(headed, top.cells).otherwise(empty)).alias("headers"),
        F.when(table, rest).alias("rows"),
    )
    bare = items.where("kind = 'text'").join(nodes.select(*PAGE).distinct(), PAGE, "left_anti")
    bare = bare.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), _line().alias("s")))).alias("p"))
    bare = bare.select(*PAGE, tx.trim(F.array_join("p.s", "")).alias("text")).where("text <> ''")
    no = F.lit(None)
    shape = {"elem_ord": F.lit(1), "type": F.lit("paragraph"), "level": no.cast("int"), "label": no.cast("string"), "items": no.cast("array<string>"), "headers": no.cast("array<string>"), "rows": no.cast("array<array<string>>")}
    return tagged.unionByName(bare.withColumns(shape).select(*CONTENT))


def section_content(elements: DataFrame, secs: DataFrame, doc_stats: DataFrame | None = None) -> DataFrame:
    """The elements of each section: those of its pages from its heading on (spec_id, ord, section, page, elem_ord, ...).

    The heading is the first that begins with the section's number and a space; for an annex without such, the first that begins
    with the number; without either, all is kept. Nothing is cut off at the end, so sections that share a page share elements.
    """
    pages = secs.select("spec_id", "ord", "section", F.explode(F.sequence(F.greatest(F.lit(1), "page"), F.greatest(F.lit(1), "page", "end_page"))).alias("page"))
    rows = pages.join(elements, ["spec_id", "page"])
    whole = Window.partitionBy("spec_id", "ord")
    rows = rows.withColumn("spot", F.struct("page", "elem_ord"))
    heading = F.col("type") == "heading"
    exact = F.min(F.when(heading & F.startswith("text", F.concat("section", F.lit(" "))), F.col("spot"))).over(whole)
    annex = F.min(F.when(heading & F.startswith("section", F.lit("Annex ")) & F.startswith("text", F.col("section")), F.col("spot"))).over(whole)
    kept = rows.withColumn("from", F.coalesce(exact, annex)).where(F.col("from").isNull() | (F.col("spot") >= F.col("from")))
    number = F.row_number().over(whole.orderBy("page", "elem_ord"))
    return kept.withColumn("elem_ord", number).drop("spot", "from")

"""Outlines: from adjacency rows (spec_id, entry_id, parent_id, sib_ord, title, page) to numbered sections with page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators.recursion import recursive
from folioflow.sources import shared

#: Depth down to which outlines are followed.
MAX_LEVELS = 64
#: Parts that a document's entries are dealt to where they meet what is known of the document.
SALTS = 64


def _walk(entries: DataFrame, resolved_only: bool) -> DataFrame:
    """Entries with depth, parent key and path, from the roots down, by a recursive query; what hangs below a left-out entry is left out too."""
    keyed = entries.withColumn("number", tx.section_number(F.col("title"))).withColumn("key", F.coalesce("number", "title"))
    cols = "spec_id, entry_id, parent_id, sib_ord, title, page, number, key"
    return recursive(
        keyed.where(F.col("page") >= 1) if resolved_only else keyed,
        f"""
        WITH RECURSIVE walk ({cols}, depth, parent, path, live) MAX RECURSION LEVEL {MAX_LEVELS} AS (
          SELECT {cols}, 0, CAST(NULL AS STRING), array(sib_ord), parent_id IS NULL FROM {{rows}}
          UNION ALL
          SELECT /*+ MERGE(c) */ {", ".join("c." + c.strip() for c in cols.split(","))}, w.depth + 1, w.key, array_append(w.path, c.sib_ord), true
          FROM walk w JOIN {{rows}} c ON w.live AND c.spec_id = w.spec_id AND c.parent_id = w.entry_id)
        SELECT {cols}, depth, parent, path FROM walk WHERE live""",
    )


def _in_order(walk: DataFrame) -> DataFrame:
    """``walk`` with ``ord``, an entry's place in its document in reading order, and ``following``, the page of the next one.

    Entries are dealt by ranges of that order, so no task sorts a document. The first rows of a document's ranges meet, to be told
    what the ranges before hold and how the next one begins, and tell the others of theirs.
    """
    at = ["path", "entry_id"]
    rows = walk.repartitionByRange("spec_id", *at).withColumn("range", F.spark_partition_id())
    own = Window.partitionBy("spec_id", "range")
    rows = rows.select("*", F.row_number().over(own.orderBy(*at)).alias("inside"), F.lead("page").over(own.orderBy(*at)).alias("next"), F.count("*").over(own).alias("here"))
    first = F.col("inside") == 1
    heads = Window.partitionBy("spec_id", F.when(~first, F.col("range"))).orderBy("range")
    before = F.coalesce(F.sum(F.when(first, F.col("here"))).over(heads.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", F.when(first, before).alias("before"), F.when(first, F.lead("page").over(heads)).alias("behind"))
    ord_ = (F.max("before").over(own) + F.col("inside")).cast("int")
    following = F.when(F.col("inside") < F.col("here"), F.col("next")).otherwise(F.max("behind").over(own))
    return rows.select(*walk.columns, ord_.alias("ord"), following.alias("following"))


def sections(entries: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """Sections in reading order (spec_id, ord, section, title, page, end_page, depth, parent, children).

    Entries without a page are left out with all that is below them. ``section`` is the number, or the title where there is
    none. A section ends on the page before the next one begins, but not before its own page, and not behind the last page.
    """
    walk = _in_order(_walk(entries, resolved_only=True))
    # children hang on entries alone: those of an entry that is reached are reached if they have a page
    key = F.coalesce(tx.section_number(F.col("title")), "title").alias("key")
    paged = entries.where((F.col("page") >= 1) & F.col("parent_id").isNotNull())
    kids = paged.groupBy("spec_id", F.col("parent_id").alias("entry_id")).agg(F.array_sort(F.collect_list(F.struct("sib_ord", key))).alias("kids"))
    # each document's row is there SALTS times, so that its entries do not all meet it in one task
    stats = doc_stats.select("spec_id", "total_pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    following = F.col("following")
    end = F.when(following.isNull(), F.col("total_pages")).otherwise(F.least(F.col("total_pages"), F.greatest(F.col("page"), following - 1)))
    return (
        walk.join(kids, ["spec_id", "entry_id"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int"))
        .join(stats, ["spec_id", "salt"])
        .select(
            "spec_id",
            "ord",
            F.col("key").alias("section"),
            tx.section_title(F.col("title"), F.col("number")).alias("title"),
            "page",
            end.alias("end_page"),
            "depth",
            "parent",
            F.coalesce(F.col("kids.key"), F.array().cast("array<string>")).alias("children"),
        )
    )


def tree_rows(entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The whole outline in reading order, entries without a page too, down to max_depth levels (spec_id, ord, entry_id, parent_id, section, title, page, depth)."""
    walk = _in_order(_walk(entries, resolved_only=False))
    rows = walk.select("spec_id", "ord", "entry_id", "parent_id", F.col("number").alias("section"), "title", "page", "depth")
    return rows.where(F.col("depth") < max_depth) if max_depth else rows


def nested(tree: DataFrame, levels: int = 10) -> DataFrame:
    """The whole tree of each document as one JSON array (spec_id, tree), from rows of :func:`tree_rows`; deeper entries than ``levels`` are left out.

    Trees are put together from the deepest level up: each level's entries take in the arrays of their children, so there is
    a grouping per level, and a document's tree is one value. Entries of a parent are in reading order. They are written first, as
    each level reads them.
    """
    own = F.to_json(F.struct("title", "page", F.col("section").alias("sectionNumber")), {"ignoreNullFields": "false"})
    rows = tree.where(F.col("depth") < levels).select("spec_id", "entry_id", "parent_id", "ord", "depth", F.regexp_replace(own, "\\}\\z", "").alias("own"))
    rows = shared.written(rows, "tree")
    below: DataFrame | None = None
    for depth in reversed(range(levels)):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("kids", F.lit(None).cast("string"))
        else:
            level = level.join(below, (level["spec_id"] == below["of_spec"]) & (level["entry_id"] == below["of"]), "left").drop("of_spec", "of")
        made = F.concat("own", F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}"))
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", made.alias("json")))), lambda k: k["json"]), ",")
        below = level.groupBy(F.col("spec_id").alias("of_spec"), F.col("parent_id").alias("of")).agg(kids.alias("kids"))
    return below.select(F.col("of_spec").alias("spec_id"), F.concat(F.lit("["), "kids", F.lit("]")).alias("tree"))


def section_keys(secs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """What a section can be looked up by (spec_id, key, ord): its number, of equal ones the last; in lower case, the first, unless that is a number.

    Columns of the section may be carried along. Sections are read once.
    """
    names = F.array(F.struct(F.col("section").alias("key"), F.lit(True).alias("exact")), F.struct(F.lower("section").alias("key"), F.lit(False).alias("exact")))
    rows = secs.select("spec_id", F.struct("ord", *carry).alias("at"), "section", F.explode(names).alias("n")).where((F.col("n.key") != F.col("section")) | F.col("n.exact"))
    exact, ord_ = F.col("n.exact"), F.col("at.ord")
    best = rows.groupBy("spec_id", F.col("n.key").alias("key")).agg(F.max_by(F.when(exact, F.col("at")), F.when(exact, ord_)).alias("e"), F.min_by(F.when(~exact, F.col("at")), F.when(~exact, ord_)).alias("l"))
    return best.select("spec_id", "key", F.coalesce("e", "l").alias("at")).select("spec_id", "key", "at.*")


def find_sections(secs: DataFrame, queries: DataFrame) -> DataFrame:
    """For each row of ``queries`` (spec_id, query) the section it names, or nulls: as written, in lower case, or one letter as an annex."""
    names = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("query").alias("key")),
        F.struct(F.lit(2).alias("rank"), F.lower("query").alias("key")),
        F.struct(F.lit(3).alias("rank"), F.when(F.rlike("query", F.lit("^[A-Za-z]\\z")), F.concat(F.lit("Annex "), F.upper("query"))).alias("key")),
    )
    rest = tuple(c for c in secs.columns if c not in ("spec_id", "ord"))
    tried = queries.select("spec_id", "query", F.explode(names).alias("n")).select("spec_id", "query", "n.*").join(section_keys(secs, rest), ["spec_id", "key"])
    best = tried.groupBy("spec_id", "query").agg(F.min_by(F.struct("ord", *rest), "rank").alias("s")).select("spec_id", "query", "s.*")
    return queries.join(best, ["spec_id", "query"], "left")


def suggest(secs: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The first sections of each document whose number begins with the query or the other way round, in any case."""
    key, low = F.lower("section"), F.lit(query.lower())
    near = secs.where(F.startswith(key, low) | F.startswith(low, key))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("spec_id").orderBy("ord"))).where(F.col("n") <= most).select("spec_id", "ord", "section")


def leaves(matched: DataFrame) -> DataFrame:
    """Of some sections, those that have no child among them. They are read once: each meets its parent's mention of it."""
    whole = F.struct(*matched.columns)
    me = F.struct(F.col("section").alias("key"), whole.alias("row"))
    mentions = F.transform("children", lambda c: F.struct(c.alias("key"), F.lit(None).cast(matched.select(whole.alias("r")).schema["r"].dataType).alias("row")))
    rows = matched.select("spec_id", "ord", F.explode(F.concat(F.array(me), mentions)).alias("x")).select("spec_id", "ord", "x.*")
    there = F.max(F.col("row").isNotNull()).over(Window.partitionBy("spec_id", "key"))
    has_child = F.max(F.col("row").isNull() & F.col("there")).over(Window.partitionBy("spec_id", "ord"))
    return rows.withColumn("there", there).withColumn("has_child", has_child).where(F.col("row").isNotNull() & ~F.col("has_child")).select("row.*")


def subtree(secs: DataFrame, root: str) -> DataFrame:
    return secs.where(tx.subtree(F.col("section"), root))


def counts(secs: DataFrame) -> DataFrame:
    """Per document the number of sections, and of the keys they can be looked up by. Sections are read once."""
    names = F.array_distinct(F.array(F.col("section"), F.lower("section")))
    keys = secs.select("spec_id", "section", F.explode(names).alias("key")).groupBy("spec_id", "key").agg(F.count_if(F.col("key") == F.col("section")).alias("n"))
    return keys.groupBy("spec_id").agg(F.sum("n").alias("total_sections"), F.count("*").alias("outline_entries"))


#: Pages are lined up with sections in spans of so many, so that no task sorts a whole document.
SPAN = 4096


def page_sections(pages: DataFrame, secs: DataFrame) -> DataFrame:
    """``pages`` (spec_id, page, ...) with ``section``, the one a page lies in: '' before the first.

    It is the last section in reading order before the first one that begins behind the page. Sections and pages are lined up
    by the largest page so far, span by span; into each span comes the section that lasts from the spans before. So there is no
    range join, and the sort is that of a span.
    """
    span = F.floor(F.col("page") / SPAN).alias("span")
    so_far = F.max("page").over(Window.partitionBy("spec_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    marks = secs.select("spec_id", "ord", "section", so_far.alias("page")).groupBy("spec_id", "page").agg(F.max_by("section", "ord").alias("mark")).select("*", span)
    rows = pages.drop("section").select("*", span)
    spans = marks.groupBy("spec_id", "span").agg(F.max_by("mark", "page").alias("last"))
    spans = spans.unionByName(rows.select("spec_id", "span").distinct(), allowMissingColumns=True).groupBy("spec_id", "span").agg(F.max("last").alias("last"))
    before = Window.partitionBy("spec_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("spec_id", "span", F.last("last", ignorenulls=True).over(before).alias("mark"), F.lit(0).alias("kind"))
    run = Window.partitionBy("spec_id", "span").orderBy("kind0", "page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    every = rows.withColumn("kind", F.lit(2)).unionByName(marks.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    every = every.withColumn("kind0", F.col("kind") > 0)  # what lasts from before comes first
    every = every.withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(run), F.lit("")))
    return every.where("kind = 2").drop("mark", "kind", "kind0", "span")

"""What became of the sections of one document in another: matched by title, else added or removed."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators.outline import section_keys


def _with_context(secs: DataFrame) -> DataFrame:
    """Sections with their normalised title and context: the parent's title before their own."""
    titled = secs.withColumn("norm", tx.norm_title(F.col("title")))
    keys = section_keys(secs, ("title",)).select("spec_id", F.col("key").alias("parent"), tx.norm_title(F.col("title")).alias("parent_norm"))
    context = F.when(F.col("parent_norm").isNotNull() & (F.col("parent") != ""), F.concat("parent_norm", F.lit(" > "), "norm")).otherwise(F.col("norm"))
    return titled.join(keys, ["spec_id", "parent"], "left").withColumn("context", context).select("ord", "section", "title", "norm", "context")


def compare(secs: DataFrame, old_spec: str, new_spec: str) -> DataFrame:
    """Rows of kind matched, added or removed: kind, old_section, new_section, title, status, ord.

    An old section is matched to the only new one of its title, or, of several, to the first in the same context. Each new
    section (by number) goes to the first old one that asks for it; an old one that comes too late, or has nothing to ask for,
    is removed, and a new one that nobody gets is added. Untitled old sections are left out. ``status`` is same or moved, by
    number; ``title`` is the new title of a match.
    """
    old = _with_context(secs.where(F.col("spec_id") == old_spec)).where("norm <> ''")
    new = _with_context(secs.where(F.col("spec_id") == new_spec))
    target = F.struct("section", "title")
    by_context = new.where("norm <> ''").groupBy("norm", "context").agg(F.count("*").alias("n"), F.min(F.struct("ord", target.alias("to"))).alias("first"))
    by_title = by_context.groupBy("norm").agg(F.sum("n").alias("n"), F.min("first").alias("only"))
    asked = old.join(by_title, "norm", "left").join(by_context.select("norm", "context", "first"), ["norm", "context"], "left")
    asked = asked.withColumn("to", F.when(F.col("n") == 1, F.col("only.to")).when(F.col("n") > 1, F.col("first.to")))
    # who has nothing to ask for takes no turn: each such row is a partition of its own
    turn = F.row_number().over(Window.partitionBy("to.section", F.when(F.col("to").isNull(), F.col("ord"))).orderBy("ord"))
    asked = asked.select("section", "title", "ord", "to", (F.col("to").isNotNull() & (turn == 1)).alias("got"))
    # one join tells matched, removed and added apart: a section number that someone got is not added, however often it is there
    olds = asked.select(F.when(F.col("got"), F.col("to.section")).alias("number"), F.struct("section", "title", "ord", "to", "got").alias("o"))
    news = new.groupBy(F.col("section").alias("number")).agg(F.collect_list(F.struct("title", "ord")).alias("n"))
    no = F.lit(None).cast("string")
    o, added = F.col("o"), F.transform("n", lambda n: F.struct(F.lit("added").alias("kind"), no.alias("old_section"), F.col("number").alias("new_section"), n["title"].alias("title"), no.alias("status"), n["ord"].alias("ord")))
    matched = F.struct(F.lit("matched").alias("kind"), o["section"].alias("old_section"), o["to"]["section"].alias("new_section"), o["to"]["title"].alias("title"), F.when(o["section"] == o["to"]["section"], "same").otherwise("moved").alias("status"), o["ord"].alias("ord"))
    removed = F.struct(F.lit("removed").alias("kind"), o["section"].alias("old_section"), no.alias("new_section"), o["title"].alias("title"), no.alias("status"), o["ord"].alias("ord"))
    return olds.join(news, "number", "full").select(F.inline(F.when(o.isNull(), added).when(o["got"], F.array(matched)).otherwise(F.array(removed))))


def _longest(j: np.ndarray) -> np.ndarray:
    """Which of some different numbers make up a longest rising run, in order; of several the one whose last numbers are least."""
    tails, tail_at, before = [], [], np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):
        n = bisect_left(tails, x)
        before[k] = tail_at[n - 1] if n else -1
        tails[n : n + 1], tail_at[n : n + 1] = [x], [k]
    keep, at = np.zeros(len(j), bool), tail_at[-1] if tail_at else -1
    while at >= 0:
        keep[at] = True
        at = before[at]
    return keep


def preview(compared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed inside matched sections: old_section, new_section, kind (kept, removed, added), old_ord, new_ord, text.

    ``old`` and ``new`` are the contents of the two documents (section, elem_ord, text), ``compared`` comes from
    :func:`compare`. Texts that are there once on either side are anchors; the longest run of them in the same order is kept.
    Between two anchors the texts that agree one by one from the front are kept, and of the others those from the back; the
    rest is removed or added, so what moved is both. Elements without a text are left out. Of a pair's anchors one task has
    the places alone; a section that two rows match is compared with each.
    """
    pair = ["old_section", "new_section"]
    # by sorting: a content whose files are small would be broadcast whole
    pairs = compared.where("kind = 'matched'").select(*pair).distinct()
    sides = [c.where("text IS NOT NULL").select(F.col("section").alias(name), F.lit(k).alias("side"), F.col("elem_ord").cast("bigint").alias("pos"), "text", F.md5("text").alias("h")).join(pairs.hint("merge"), name) for k, (c, name) in enumerate(zip((old, new), pair))]
    rows = sides[0].unionByName(sides[1])
    at = [F.min(F.when(F.col("side") == k, F.col("pos"))).alias(c) for k, c in enumerate("ij")]
    counts = [F.count_if(F.col("side") == k) == 1 for k in (0, 1)]
    anchors = rows.groupBy(*pair, "h").agg(*at, (counts[0] & counts[1]).alias("once")).where("once").select(*pair, "i", "j")

    def longest(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("i")
        return found[_longest(found["j"].to_numpy())]

    kept = anchors.groupBy(*pair).applyInPandas(longest, anchors.schema)
    marks = kept.select(*pair, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("j").alias("pos")))).alias("m")).select(*pair, "m.side", "m.pos", F.lit(True).alias("anchor"))
    placed = rows.join(marks, [*pair, "side", "pos"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    # gaps are numbered by the anchors before them, and have the same numbers on both sides
    so_far = Window.partitionBy(*pair, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("gap", F.count_if("anchor").over(so_far))
    inside = Window.partitionBy(*pair, "side", "gap", "anchor")
    placed = placed.withColumn("front", F.row_number().over(inside.orderBy("pos"))).withColumn("back", F.row_number().over(inside.orderBy(F.desc("pos"))))
    here = F.struct("pos", "text", "h", "back")
    # who is k-th from the front on either side; anchors are so by themselves
    met = placed.groupBy(*pair, "gap", "anchor", "front").agg(*[F.max(F.when(F.col("side") == k, here)).alias(c) for k, c in enumerate("ab")])
    run = Window.partitionBy(*pair, "gap", "anchor").orderBy("front").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("differ", F.sum(F.when(F.col("a.h") == F.col("b.h"), 0).otherwise(1)).over(run))
    same = met.where("differ = 0").select(*pair, "a", "b")
    left = met.where("differ > 0").select(*pair, "gap", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("side"), F.col(c).alias("x"))) for c in "ab"]))).alias("e")).select(*pair, "gap", "e.side", "e.x")
    met = left.groupBy(*pair, "gap", F.col("x.back").alias("back")).agg(*[F.max(F.when(F.col("side") == c, F.col("x"))).alias(c) for c in "ab"])
    run = Window.partitionBy(*pair, "gap").orderBy("back").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("differ", F.sum(F.when(F.col("a.h") == F.col("b.h"), 0).otherwise(1)).over(run))

    no = F.lit(None).cast("bigint")

    def row(kind: str, i: Column, j: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("old_ord"), j.alias("new_ord"), text.alias("text"))

    both = row("kept", F.col("a.pos"), F.col("b.pos"), F.col("a.text"))
    apart = F.array_compact(F.array(F.when(F.col("a").isNotNull(), row("removed", F.col("a.pos"), no, F.col("a.text"))), F.when(F.col("b").isNotNull(), row("added", no, F.col("b.pos"), F.col("b.text")))))
    ends = met.select(*pair, F.inline(F.when(F.col("differ") == 0, F.array(both)).otherwise(apart)))
    return same.select(*pair, F.inline(F.array(both))).unionByName(ends)


def within(compared: DataFrame, root: str) -> DataFrame:
    """Rows one of whose numbers is ``root`` or below it."""
    either = [F.coalesce(tx.subtree(F.col(c), root), F.lit(False)) for c in ("old_section", "new_section")]
    return compared.where(either[0] | either[1])

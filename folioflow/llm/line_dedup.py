"""Removing boilerplate lines that many sites share, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, materialize, read

#: A line goes when so many distinct sites carry it.
MIN_SITES = 10
#: Sketches of 2**LG_K registers err by 1.04 / 2**(LG_K / 2); lines whose estimate is within NEAR of the threshold, over three times that, are counted exactly.
LG_K, NEAR = 12, 0.06
#: Copies of one text are dealt to so many parts when positions meet documents.
PARTS = 16


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(empty_if_null(text)))


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """Line digests of ``docs``: text_key, pos (from 0), h (16 bytes, so that no two of 10**12 lines share one by chance) and the site's hash; blank lines are left out."""
    lines = docs.select(text_key().alias("text_key"), F.xxhash64(F.coalesce(F.col(site), F.lit(""))).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("text_key", "pos", F.unhex(F.md5("line")).alias("h"), "site")


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The digests of ``lines`` (h, site) that at least min_sites distinct sites carry.

    A HyperLogLog sketch of sites per line digest is filled in each task and merged by the aggregation, so a line that is
    everywhere costs one sketch a task. Estimates near the threshold give way to exact distinct counts.
    """
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = materialize(sketched.where(F.col("sites") >= F.lit(min_sites * (1 - NEAR) - 1)), "line-spread")
    near = sketched.where(F.col("sites") <= F.lit(min_sites * (1 + NEAR) + 1))
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h", "site").count().groupBy("h").count().where(F.col("count") >= min_sites)
    sure = sketched.where(F.col("sites") > F.lit(min_sites * (1 + NEAR) + 1))
    return sure.select("h").unionByName(exact.select("h"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with all columns, ``text`` without boilerplate lines, and n_lines and n_removed (replacing such names).

    Lines end at ``\\n`` and are compared as they stand; blank ones stay. A null text stays null, with no lines; an empty one
    has one line. A null site is a site of its own. What goes depends on the text alone, so repeated rows fare alike. The
    positions to remove are joined to documents by the text's digest; no line text is shuffled.
    """
    lines = materialize(line_table(docs, site), "lines")
    spread = materialize(site_spread(lines, min_sites), "boilerplate")
    gone = lines.join(spread, "h", "left_semi").groupBy("text_key").agg(F.collect_set("pos").alias("gone"))
    gone = gone.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    held = docs.drop("n_lines", "n_removed")
    # rows of one text go to parts by what else they hold, and equal rows by chance
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in held.columns if c != "text"], F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    whole = held.select(F.struct(*[F.col(f"`{c}`") for c in held.columns if c != "text"]).alias("row"), "text", text_key().alias("text_key"), part.alias("part"))
    none = F.array().cast("array<int>")
    joined = whole.join(gone, ["text_key", "part"], "left").select("row", "text", F.coalesce("gone", none).alias("gone"), F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")).alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    new = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[new.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in held.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text when lines that MIN_SITES sources share are gone."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_removed", F.length(empty_if_null("text")).cast("long").alias("clean_chars"), F.sha2(empty_if_null("text"), 256).alias("clean_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, text FROM documents)
), wide AS (
  SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, w.line IS NOT NULL AS gone FROM lines l LEFT JOIN wide w ON l.line = w.line
), clean AS (
  SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY rid, doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS clean_chars, sha256(text) AS clean_sha256 FROM clean
UNION ALL SELECT doc_id, 0, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

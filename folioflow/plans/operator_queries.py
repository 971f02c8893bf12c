"""Queries of single operators over whole tables, each with its SQL: what small literal rows alone showed before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import content, definitions, outline, profile, requirements, tables
from folioflow.plans import table_queries as tq
from folioflow.plans.queries import GEO, SQL, geography, query, shown, table
from folioflow.sources import registry

# --- numbers and lookups --------------------------------------------------------------------------------------------------

TITLES_SQL = """SELECT n_nationkey AS n, n_regionkey AS r, CASE n_nationkey % 6 WHEN 0 THEN 'Annex ' || chr(65 + n_nationkey) || '.' || n_regionkey || ' ' || n_name WHEN 1 THEN 'APPENDIX ' || chr(65 + n_nationkey) || ' ' || n_name
  WHEN 2 THEN n_nationkey || '. ' || n_name WHEN 3 THEN n_nationkey || '. ' || lower(n_name) WHEN 4 THEN n_regionkey || '.' || n_nationkey || '  ' || n_name ELSE n_name END AS title, n_name FROM nation"""


def nation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with titles of all forms."""
    n, letter = F.col("n_nationkey"), F.chr(65 + F.col("n_nationkey"))
    space = F.lit(" ")
    title = F.when(n % 6 == 0, F.concat(F.lit("Annex "), letter, F.lit("."), "n_regionkey", space, "n_name")).when(n % 6 == 1, F.concat(F.lit("APPENDIX "), letter, space, "n_name"))
    title = title.when(n % 6 == 2, F.concat(n, F.lit(". "), "n_name")).when(n % 6 == 3, F.concat(n, F.lit(". "), F.lower("n_name"))).when(n % 6 == 4, F.concat("n_regionkey", F.lit("."), n, F.lit("  "), "n_name"))
    return table(spark, sf_dir, "nation").select(n.alias("n"), title.otherwise(F.col("n_name")).alias("title"))


@query(f"""SELECT n, title AS whole, CASE n % 6 WHEN 0 THEN 'Annex ' || chr(65 + n) || '.' || r WHEN 1 THEN 'Appendix ' || chr(65 + n) WHEN 2 THEN n || '' WHEN 4 THEN r || '.' || n END AS section,
  CASE WHEN n % 6 IN (0, 4) THEN n_name ELSE title END AS bare FROM ({TITLES_SQL})""")
def section_numbers_table(spark, sf_dir):
    number = tx.section_number(F.col("title"))
    return nation_titles(spark, sf_dir).select("n", F.col("title").alias("whole"), number.alias("section"), tx.section_title(F.col("title"), number).alias("bare"))


@query(f"""SELECT format, count(*) AS n FROM (SELECT CASE n % 6 WHEN 0 THEN 'annex' WHEN 1 THEN 'appendix' WHEN 2 THEN 'dot-ended' WHEN 3 THEN 'dot-ended' WHEN 4 THEN 'dotted' ELSE 'none' END AS format FROM ({TITLES_SQL})
UNION ALL SELECT CASE WHEN n IS NULL THEN 'plain' ELSE 'dotted' END FROM ({GEO} SELECT * FROM entry)) GROUP BY format""")
def number_formats_table(spark, sf_dir):
    titles = nation_titles(spark, sf_dir).select("title").unionByName(geography(spark, sf_dir)[0].select("title"))
    return profile.number_formats(titles)


@query("""WITH known AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 > 0
), asked AS (SELECT 'c' || k AS id, CASE WHEN k % 2 = 0 THEN lower(name) ELSE name END AS query, name AS section, name AS title FROM known
  UNION ALL SELECT 'c' || c_custkey, c_name, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(chr(65 + n_nationkey)) ELSE chr(65 + n_nationkey) END, 'Annex ' || chr(65 + n_nationkey), n_name FROM nation)
SELECT query, section, title FROM asked""")
def find_section_table(spark, sf_dir):
    """Sections asked for by name, by name in lower case, by a letter, and in vain."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    letter = F.chr(65 + F.col("n_nationkey"))
    no = F.lit(None).cast("bigint")
    entries = customer.where("c_custkey % 3 > 0").select(F.lit("d").alias("spec_id"), F.col("c_custkey").alias("entry_id"), no.alias("parent_id"), F.col("c_custkey").cast("int").alias("sib_ord"), F.col("c_name").alias("title"), F.lit(1).alias("page"))
    entries = entries.union(nation.select(F.lit("d"), -F.col("n_nationkey").cast("bigint") - 1, no, -F.col("n_nationkey") - 1, F.concat(F.lit("Annex "), letter, F.lit(" "), "n_name"), F.lit(1)))
    k = F.col("c_custkey")
    asked = customer.select(F.lit("d").alias("spec_id"), F.when((k % 3 > 0) & (k % 2 == 0), F.lower("c_name")).otherwise(F.col("c_name")).alias("query"))
    asked = asked.union(nation.select(F.lit("d"), F.when(F.col("n_nationkey") % 2 == 0, F.lower(letter)).otherwise(letter)))
    stats = spark.createDataFrame([("d", 9)], "spec_id string, total_pages int")
    return outline.find_sections(outline.sections(entries, stats), asked).select("query", "section", "title")


# --- texts ------------------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{2028}-\\x{202F}\\x{FEFF}]', '', 'g')) AS text FROM documents")
def strip_invisible_table(spark, sf_dir):
    """Documents with invisible characters put behind every space and at both ends."""
    planted = F.concat(F.lit(chr(0xFEFF)), F.replace("text", F.lit(" "), F.lit(" " + chr(0x200B) + chr(0x200E))), F.lit(chr(0x2028)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.strip_invisible(planted)).alias("text"))


@query("SELECT doc_id AS page, 1 AS elem_ord, 'paragraph' AS type, md5(regexp_replace(replace(text, chr(10), ''), '^\\s+|\\s+$', '', 'g')) AS text FROM documents WHERE doc_id % 2 = 1 AND regexp_replace(text, '\\s+', '', 'g') <> ''")
def untagged_pages_table(spark, sf_dir):
    """Documents as pages of which every other one has a root node: those that have none are a paragraph each."""
    root = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("lang").alias("spec_id"), F.col("doc_id").alias("page"), F.lit(1).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("sib_ord"), F.lit("Root").alias("role"), F.lit(None).cast("string").alias("content_id"))
    return content.page_elements(root, tq.document_items(spark, sf_dir)).select("page", "elem_ord", "type", F.md5("text").alias("text"))


SHALL = {0: ("shall", "The {n} shall be kept."), 1: ("shall not", "It Shall Not fail; see 2.{k} Shall it?"), 2: ("should", "Why? A {n} should fit"), 3: ("may", "The {n} mays; it may do! Done."), 4: ("should not", "In 20. Parts should not bend.")}


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS section, p_name AS n, p_size % 5 AS f FROM part
), r AS (
  SELECT section, k, 1 AS i, CASE f WHEN 0 THEN 'shall' WHEN 1 THEN 'shall not' WHEN 2 THEN 'should' WHEN 3 THEN 'may' ELSE 'should not' END AS level,
    CASE f WHEN 0 THEN 'The ' || n || ' shall be kept.' WHEN 1 THEN 'It Shall Not fail; see 2.' || k || ' Shall it?' WHEN 2 THEN 'A ' || n || ' should fit' WHEN 3 THEN 'The ' || n || ' mays; it may do!' ELSE 'In 20. Parts should not bend.' END AS text FROM p
  UNION ALL SELECT section, k, 2, 'shall', 'It Shall Not fail; see 2.' || k || ' Shall it?' FROM p WHERE f = 1
) SELECT 'R-' || section || '-' || row_number() OVER (PARTITION BY section ORDER BY k, i) AS id, level, text FROM r""")
def requirements_keywords_table(spark, sf_dir):
    """The keywords themselves, longer ones first, in sentences about every part."""
    text = F.lit(None).cast("string")
    for f, (_, says) in SHALL.items():
        text = F.when(F.col("p_size") % 5 == f, F.replace(F.replace(F.lit(says), F.lit("{n}"), F.col("p_name")), F.lit("{k}"), F.col("p_partkey").cast("string"))).otherwise(text)
    rows = table(spark, sf_dir, "part").select(F.lit("d").alias("spec_id"), F.col("p_brand").alias("section"), F.col("p_partkey").alias("elem_ord"), F.lit("paragraph").alias("type"), text.alias("text"), F.lit(None).cast("array<string>").alias("items"))
    return requirements.extract(rows).select("id", "level", "text")


# --- terms and tables -------------------------------------------------------------------------------------------------------

@query(f"SELECT term, definition FROM ({SQL['definitions_table']}) WHERE contains(lower(term), 'building') OR contains(lower(definition), 'building')")
def definitions_matching_table(spark, sf_dir):
    return definitions.matching(tq.definitions_table(spark, sf_dir), "BUILDING").select("term", "definition")


@query("""SELECT 'n' || c_nationkey AS spec_id, row_number() OVER w AS number, c_name AS term, 'In ' || c_mktsegment || '.' AS definition, '3.' || row_number() OVER w AS section FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def definitions_lists_table(spark, sf_dir):
    """Terms under headings with numbers, with lists of numbers between them, behind the section's own heading and before the next section's."""
    key, no = F.col("c_custkey"), F.lit(None)

    def element(i: int, kind: str, text=no, items=no):  # noqa: ANN001, ANN202
        return F.struct((key * 4 + i).alias("elem_ord"), F.lit(kind).alias("type"), text.cast("string").alias("text"), no.cast("string").alias("label"), items.cast("array<string>").alias("items"))

    numbers = F.array(F.concat(F.lit("3."), key, F.lit("\n3."), key + 1), F.lit("3.7"))
    rows = F.array(element(0, "heading", F.concat(F.lit("3."), key, F.lit(" "), "c_name")), element(1, "list", items=numbers), element(2, "paragraph", F.concat(F.lit("In "), "c_mktsegment", F.lit("."))))
    each = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("spec_id"), F.explode(rows).alias("e")).select("spec_id", "e.*")
    empty = F.lit(None).cast("string")
    ends = each.select("spec_id").distinct().select("spec_id", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("elem_ord"), F.lit("3 Terms").alias("text")), F.struct(F.lit(1 << 60).alias("elem_ord"), F.lit("4 Next").alias("text")), F.struct(F.lit((1 << 60) + 1).alias("elem_ord"), F.lit("3.99 Lost").alias("text")), F.struct(F.lit((1 << 60) + 2).alias("elem_ord"), F.lit("3.99").alias("text")))).alias("e"))
    ends = ends.select("spec_id", "e.elem_ord", F.lit("heading").alias("type"), "e.text", empty.alias("label"), F.lit(None).cast("array<string>").alias("items"))
    return definitions.extract(each.unionByName(ends)).select("spec_id", "number", "term", "definition", "section")


@query(f"SELECT section, caption, headers, cells FROM ({SQL['tables_table']}) WHERE \"index\" = 2")
def table_pick_table(spark, sf_dir):
    return tq.tables_table(spark, sf_dir).where("index = 2").drop("index")


@query("""WITH p AS (SELECT p_brand AS section, p_partkey AS k, p_name, p_type, p_size, p_partkey % 9 = 0 AS cap FROM part
), g AS (SELECT *, sum(CASE WHEN cap THEN 1 ELSE 0 END) OVER (PARTITION BY section ORDER BY k ROWS UNBOUNDED PRECEDING) AS t FROM p
), s AS (SELECT *, sum(CASE WHEN NOT cap AND p_size % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY section, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM g WHERE t > 0
), kept AS (SELECT *, p_name || '|' || CASE WHEN p_size % 2 = 0 THEN p_type || '|' || p_size ELSE p_size || '' END AS line, row_number() OVER (PARTITION BY section, t ORDER BY k) AS r FROM s WHERE stop = 0 AND NOT cap
), caption AS (SELECT section, t, 'Table ' || k || ' - ' || p_type AS caption FROM g WHERE cap
), whole AS (SELECT section, t, max(CASE WHEN r = 1 THEN line END) AS headers, coalesce(string_agg(CASE WHEN r > 1 THEN line END, '/' ORDER BY k), '') AS cells FROM kept GROUP BY ALL)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY t) - 1 AS INT) AS "index", caption, headers, cells FROM whole JOIN caption USING (section, t)""")
def text_tables_table(spark, sf_dir):
    """Tables written as lines of parts: cells behind tabs or two spaces, ended by a line of one cell, or the next caption."""
    k, size = F.col("p_partkey"), F.col("p_size")
    line = F.when(size % 2 == 0, F.concat_ws("\t", "p_name", F.concat(F.lit(" "), "p_type"), size)).otherwise(F.concat_ws("   ", "p_name", size))
    text = F.when(k % 9 == 0, F.concat(F.lit("Table "), k, F.lit(" - "), "p_type")).when(size % 10 == 0, F.lit("one cell")).otherwise(line)
    rows = table(spark, sf_dir, "part").select(F.lit("d").alias("spec_id"), F.col("p_brand").alias("section"), k.alias("elem_ord"), F.lit("paragraph").alias("type"), text.alias("text"), F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return shown(tables.section_tables(rows)).withColumn("index", F.col("index").cast("int"))


# --- registry and timings ---------------------------------------------------------------------------------------------------

@query(f"SELECT * FROM ({SQL['registry_files']}) WHERE category = 'appnote'")
def list_by_category_table(spark, sf_dir):
    return registry.list_specs(tq.registry_files(spark, sf_dir), "appnote")


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of each priority were placed in each month, as timings of runs."""
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM").alias("run"))
    return months.agg(F.count("*").cast("double").alias("ms"))


MONTHS = "SELECT o_orderpriority AS name, strftime(o_orderdate, '%Y-%m') AS run, count(*)::DOUBLE AS ms FROM orders GROUP BY ALL"


@query(f"SELECT name, run, ms, (ms - lag(ms) OVER w) * 100.0 / lag(ms) OVER w AS change FROM ({MONTHS}) WINDOW w AS (PARTITION BY name ORDER BY run)")
def timing_changes_table(spark, sf_dir):
    return profile.changes(month_counts(spark, sf_dir)).select("name", "run", "ms", "change")


@query(f"""WITH m AS ({MONTHS}), n AS (SELECT name || ' ' || substr(run, 6) AS name, ms FROM m WHERE run LIKE '1996%'), b AS (SELECT name || ' ' || substr(run, 6) AS name, ms AS base_ms FROM m WHERE run LIKE '1995%')
SELECT name, ms AS now_ms, base_ms, (ms - base_ms) * 100.0 / base_ms AS change, (ms - base_ms) * 100.0 / base_ms > 20 AS slower FROM n JOIN b USING (name)""")
def regressions_table(spark, sf_dir):
    """A year's months against those of the year before."""
    runs = month_counts(spark, sf_dir).select(F.concat_ws(" ", "name", F.substring("run", 6, 2)).alias("name"), F.substring("run", 1, 4).alias("year"), "ms")
    return profile.regressions(runs.where("year = '1996'").drop("year"), runs.where("year = '1995'").drop("year"))


# --- trees --------------------------------------------------------------------------------------------------------------------

@query(GEO + """, low AS (SELECT r, n, string_agg('{"title":"' || section || ' ' || title || '","page":' || page || ',"sectionNumber":"' || section || '","children":[]}', ',' ORDER BY c) AS kids FROM entry WHERE c IS NOT NULL GROUP BY ALL
), mid AS (SELECT e.r, string_agg('{"title":"' || section || ' ' || title || '","page":' || page || ',"sectionNumber":"' || section || '","children":[' || coalesce(kids, '') || ']}', ',' ORDER BY e.n) AS kids FROM entry e LEFT JOIN low USING (r, n) WHERE e.n IS NOT NULL AND e.c IS NULL GROUP BY e.r)
SELECT 'world' AS spec_id, md5('[' || string_agg('{"title":"' || section || ' ' || title || '","page":' || page || ',"sectionNumber":"' || section || '","children":[' || coalesce(kids, '') || ']}', ',' ORDER BY e.r) || ']') AS tree, count(*) AS top FROM entry e LEFT JOIN mid USING (r) WHERE e.n IS NULL""")
def outline_nested(spark, sf_dir):
    """The whole tree of regions, nations and customers as one value."""
    nested = outline.nested(outline.tree_rows(geography(spark, sf_dir)[0]))
    return nested.select("spec_id", F.md5("tree").alias("tree"), F.json_array_length("tree").cast("bigint").alias("top"))


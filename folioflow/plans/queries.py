"""Queries of every operator over the shared tables, with the same in SQL.

Documents stand for pages (language: document, source: section, doc_id: page) and their lines for paragraphs; regions, nations
and customers for an outline; suppliers for sections with pages out of order; web pages for tagged content and two versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import compare, content, definitions, outline, profile, requirements, search, tables
from folioflow.plans import fixtures as fx
from folioflow.sources import html, registry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Queries of a few literal rows, which tests run: each operator of theirs has registered queries over whole tables.
FIXED: dict = {}
FIXED_SQL: dict[str, str] = {}


def fixed(sql: str):
    def add(f):
        FIXED[f.__name__], FIXED_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(parts: Column, mark: str = "|") -> Column:
    return F.array_join(parts, mark)


# --- search over documents ---------------------------------------------------------------------------------------------

def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("spec_id"), F.col("source").alias("section"), F.col("doc_id").alias("page"), "text")


NORMAL = "regexp_replace(regexp_replace(lower(text), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')"


def search_sql(phrase: str, words: list[str], most: int | None, per_spec: bool = True, columns: str = "spec_id, section, page, score, snippet", query_length: int | None = None) -> str:
    every = " AND ".join(f"contains(nt, '{w}')" for w in words) if len(words) >= 2 else "false"
    total = " + ".join(f"(length(nt) - length(replace(nt, '{w}', ''))) // {len(w)}" for w in words)
    first = "least(" + ", ".join(f"instr(nt, '{w}') - 1" for w in words) + ")" if len(words) >= 2 else "-1"
    q = query_length or len(phrase)
    rank = "row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, page)" if per_spec else "row_number() OVER (ORDER BY score DESC, page, spec_id)"
    return f"""
WITH normal AS (SELECT lang AS spec_id, source AS section, doc_id AS page, text, {NORMAL} AS nt FROM documents
), hit AS (
  SELECT *, contains(nt, '{phrase}') AS whole, CASE WHEN contains(nt, '{phrase}') THEN 3 * ((length(nt) - length(replace(nt, '{phrase}', ''))) // {len(phrase)}) ELSE {total} END AS score,
    CASE WHEN contains(nt, '{phrase}') THEN instr(nt, '{phrase}') - 1 ELSE {first} END AS spot FROM normal WHERE contains(nt, '{phrase}') OR ({every})
), spot AS (
  SELECT *, CASE WHEN spot <= 0 THEN 0 ELSE least(CAST(floor(CAST(spot AS DOUBLE) / length(nt) * length(text)) AS BIGINT), length(text) - 1) END AS s FROM hit
), cut AS (SELECT *, greatest(0, s - 75) AS a, least(length(text), s + {q} + 75) AS b FROM spot
), snip AS (
  SELECT spec_id, section, page, score, CASE WHEN a > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, a + 1, b - a), '^\\s+|\\s+$', '', 'g') || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet,
    row_number() OVER (PARTITION BY spec_id, section ORDER BY score DESC, page) AS n FROM cut
), best AS (SELECT *, {rank} AS r FROM snip WHERE n = 1)
SELECT {columns} FROM best {"WHERE r <= " + str(most) if most else ""}"""


@query(search_sql("of the", ["of", "the"], 10))
def search_phrase(spark, sf_dir):
    return search.search(document_pages(spark, sf_dir), "of  THE", 10)


SQL["search_phrase"] = search_sql("of the", ["of", "the"], 10, query_length=7)


@query(search_sql("that with", ["that", "with"], None))
def search_and(spark, sf_dir):
    return search.search(document_pages(spark, sf_dir), "that with", None)


@query(search_sql("cc by-nc", ["cc", "by-nc"], 5, query_length=10))
def search_hyphen(spark, sf_dir):
    return search.search(document_pages(spark, sf_dir), "CC by - nc", 5)


@query(search_sql("the", ["the"], 10, per_spec=False))
def search_cross_spec(spark, sf_dir):
    return search.search(document_pages(spark, sf_dir), "the", 10, per_spec=False)


@query(search_sql("para que", ["para", "que"], 3, columns="spec_id, section, page, score"))
def search_topk(spark, sf_dir):
    return search.search(document_pages(spark, sf_dir), "para que", 3).drop("snippet")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS norm FROM documents")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_title(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, md5({NORMAL}) AS norm FROM documents")
def norm_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_search(F.col("text"))).alias("norm"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n FROM documents")
def count_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_occurrences(F.col("text"), "the").alias("n"))


@fixed("SELECT id, CASE id WHEN 1 THEN 'a b' WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE 'q' || chr(233) END AS clean, CASE id WHEN 1 THEN 'A' || chr(160) || 'B' || chr(12288) WHEN 2 THEN ' x' WHEN 3 THEN '' ELSE 'Q' || chr(233) END AS stripped FROM range(1, 5) t(id)")
def strip_invisible(spark, sf_dir):
    rows = [(1, chr(0xFEFF) + "A" + chr(0xA0) + "B" + chr(0x3000)), (2, chr(0x200B) + " x" + chr(0x2028)), (3, chr(0x200B) + chr(0xFEFF)), (4, "Q" + chr(0xE9) + chr(0x200E))]
    t = spark.createDataFrame(rows, "id bigint, t string")
    return t.select("id", tx.norm_title(F.col("t")).alias("clean"), tx.strip_invisible(F.col("t")).alias("stripped"))


# --- outlines -----------------------------------------------------------------------------------------------------------

@fixed(fx.values("id, section, bare", (1, "7", "Syntax"), (2, "7.3.4", "String objects"), (3, "1", "1. Introduction"), (4, "4.1", "artifact"), (5, "Annex A", "Rules"), (6, "Annex A.1", "Scope"), (7, "Appendix B", "appendix B: Notes"), (8, None, "Foreword"), (9, None, ""), (10, None, "7"), (11, "12.8.1", "Two spaces"), (12, "ANNEX b", "More"), (13, "Annex a", "Annex about forms"), (14, None, "3. lower")))
def section_number_parse(spark, sf_dir):
    number = tx.section_number(F.col("title"))
    return spark.sql(fx.TITLES).select("id", number.alias("section"), tx.section_title(F.col("title"), number).alias("bare"))


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as the outline of one document; every seventh nation and fiftieth customer has no page."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    base = F.col("n_regionkey") * 100000 + F.col("n_nationkey") * 1000
    no = F.lit(None).cast("bigint")
    top = region.select(F.col("r_regionkey").cast("bigint").alias("entry_id"), no.alias("parent_id"), F.col("r_regionkey").alias("sib_ord"), F.concat(F.col("r_regionkey") + 1, F.lit(" "), "r_name").alias("title"), (F.col("r_regionkey") * 100000 + 1).alias("page"))
    number = F.concat(F.col("n_regionkey") + 1, F.lit("."), F.col("n_nationkey"))
    mid = nation.select((1000 + F.col("n_nationkey")).cast("bigint"), F.col("n_regionkey").cast("bigint"), "n_nationkey", F.concat(number, F.lit(" "), "n_name"), F.when(F.col("n_nationkey") % 7 == 6, -1).otherwise(base + 1))
    low = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        1000000 + F.col("c_custkey"), (1000 + F.col("n_nationkey")).cast("bigint"), F.col("c_custkey").cast("int"), F.concat(number, F.lit("."), "c_custkey", F.lit(" "), "c_name"), F.when(F.col("c_custkey") % 50 == 0, -1).otherwise(base + 1 + (F.col("c_custkey") % 997).cast("int"))
    )
    entries = top.union(mid).union(low).withColumn("spec_id", F.lit("world"))
    return entries, spark.createDataFrame([("world", 500000)], "spec_id string, total_pages int")


GEO = """
WITH entry AS (
  SELECT r_regionkey AS r, NULL::BIGINT AS n, NULL::BIGINT AS c, (r_regionkey + 1) || '' AS section, r_name AS title, r_regionkey * 100000 + 1 AS page FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, NULL, (n_regionkey + 1) || '.' || n_nationkey, n_name, CASE WHEN n_nationkey % 7 = 6 THEN -1 ELSE n_regionkey * 100000 + n_nationkey * 1000 + 1 END FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, (n_regionkey + 1) || '.' || n_nationkey || '.' || c_custkey, c_name,
    CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE n_regionkey * 100000 + n_nationkey * 1000 + 1 + c_custkey % 997 END FROM customer JOIN nation ON c_nationkey = n_nationkey
), good AS (SELECT * FROM entry WHERE page >= 1 AND (n IS NULL OR n % 7 <> 6)
), section AS (
  SELECT row_number() OVER w AS ord, section, title, page, CASE WHEN lead(page) OVER w IS NULL THEN 500000 ELSE least(500000, greatest(page, lead(page) OVER w - 1)) END AS end_page,
    CASE WHEN n IS NULL THEN 0 WHEN c IS NULL THEN 1 ELSE 2 END AS depth, CASE WHEN n IS NULL THEN NULL WHEN c IS NULL THEN (r + 1) || '' ELSE (r + 1) || '.' || n END AS parent, r, n, c
  FROM good WINDOW w AS (ORDER BY r, n NULLS FIRST, c NULLS FIRST)
)
"""


def geo_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.sections(*geography(spark, sf_dir))


@query(GEO + "SELECT CAST(ord AS INT) AS ord, section, title, page, CAST(end_page AS INT) AS end_page, depth, parent FROM section")
def outline_flatten(spark, sf_dir):
    return geo_sections(spark, sf_dir).select("ord", "section", "title", "page", "end_page", "depth", "parent")


@query(GEO + "SELECT s.section, coalesce(string_agg(k.section, '|' ORDER BY k.ord), '') AS children FROM section s LEFT JOIN section k ON k.parent = s.section GROUP BY s.section")
def outline_children(spark, sf_dir):
    return geo_sections(spark, sf_dir).select("section", joined(F.col("children")).alias("children"))


@query(GEO + "SELECT row_number() OVER (ORDER BY r, n NULLS FIRST) AS ord, section, title, page, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS depth FROM (SELECT section, section || ' ' || title AS title, page, r, n FROM entry WHERE c IS NULL)")
def outline_prune(spark, sf_dir):
    rows = outline.tree_rows(geography(spark, sf_dir)[0], 2)
    return rows.select(F.row_number().over(Window.partitionBy("spec_id").orderBy("ord")).alias("ord"), "section", "title", "page", "depth")


@query(GEO + "SELECT count(*) AS total_sections, count(DISTINCT section) AS outline_entries FROM section")
def outline_counts(spark, sf_dir):
    return outline.counts(geo_sections(spark, sf_dir)).select("total_sections", "outline_entries")


@query(GEO + "SELECT section, title FROM section s WHERE (section = '2' OR section LIKE '2.%') AND NOT EXISTS (SELECT 1 FROM section k WHERE k.parent = s.section)")
def outline_leaf(spark, sf_dir):
    return outline.leaves(outline.subtree(geo_sections(spark, sf_dir), "2")).select("section", "title")


@query(GEO + "SELECT section, title FROM section WHERE section = '1' OR section LIKE '1.%'")
def subtree_filter(spark, sf_dir):
    return outline.subtree(geo_sections(spark, sf_dir), "1").select("section", "title")


@query(GEO + "SELECT CAST(ord AS INT) AS ord, section FROM section WHERE starts_with(section, '3.9') OR starts_with('3.9', section) ORDER BY ord LIMIT 5")
def suggest_sections(spark, sf_dir):
    return outline.suggest(geo_sections(spark, sf_dir), "3.9").select("ord", "section")


@fixed(fx.values("query, section, title", ("7", "7", "Syntax"), ("annex a", "Annex A", "Rules"), ("A", "Annex A", "Rules"), ("ANNEX B", "ANNEX b", "More"), ("99", None, None), ("foreword", "Foreword", "Foreword")))
def find_section(spark, sf_dir):
    titles = spark.sql(fx.TITLES).where("title NOT IN ('', '7')")
    entries = titles.select(F.lit("d").alias("spec_id"), F.col("id").cast("bigint").alias("entry_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("id").alias("sib_ord"), "title", F.lit(1).alias("page"))
    stats = spark.createDataFrame([("d", 9)], "spec_id string, total_pages int")
    asked = spark.createDataFrame([("d", q) for q in ("7", "annex a", "A", "ANNEX B", "99", "foreword")], "spec_id string, query string")
    return outline.find_sections(outline.sections(entries, stats), asked).select("query", "section", "title")


@query("""
WITH sec AS (SELECT s_suppkey AS ord, s_name AS section, s_suppkey * 10 - (s_suppkey % 3) * 15 AS page FROM supplier
), run AS (SELECT *, max(page) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS m FROM sec
), mark AS (SELECT m, arg_max(section, ord) AS section FROM run GROUP BY m)
SELECT d.doc_id AS page, coalesce(m.section, '') AS section FROM documents d ASOF LEFT JOIN mark m ON d.doc_id >= m.m""")
def page_to_section_asof(spark, sf_dir):
    secs = table(spark, sf_dir, "supplier").select(F.lit("d").alias("spec_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("section"), (F.col("s_suppkey") * 10 - (F.col("s_suppkey") % 3) * 15).alias("page"))
    pages = table(spark, sf_dir, "documents").select(F.lit("d").alias("spec_id"), F.col("doc_id").alias("page"), F.lit("").alias("section"))
    return outline.page_sections(pages, secs).select("page", "section")


# --- content ------------------------------------------------------------------------------------------------------------

@fixed(fx.values("page, content_id, text", (1, "a", "one\ntwo!"), (1, "b", "bee"), (1, "c", "sea")))
def marked_text_map(spark, sf_dir):
    return content.marked_text(spark.sql(fx.MARKED)).select("page", "content_id", "text")


def fixture_elements(spark: SparkSession) -> DataFrame:
    return content.page_elements(spark.sql(fx.NODES), spark.sql(fx.ITEMS))


def flat(elements: DataFrame) -> list[Column]:
    return [joined(F.col("items")).alias("items"), joined(F.col("headers")).alias("headers"), F.array_join(F.transform("rows", lambda r: joined(r)), "/").alias("cells")]


@fixed(fx.ELEMENTS)
def page_elements(spark, sf_dir):
    e = fixture_elements(spark)
    return e.select("page", "elem_ord", "type", "level", "text", "label", *flat(e))


@fixed(fx.values("section, page, elem_ord, type", ("7", 1, 1, "heading"), *(("7", 1, i, t) for i, t in ((2, "paragraph"), (3, "note"), (4, "list"), (5, "table"), (6, "table"), (7, "heading"), (8, "code"))), ("7", 2, 9, "paragraph"), ("Annex B", 1, 1, "heading"), ("Annex B", 1, 2, "code")))
def section_head_trim(spark, sf_dir):
    secs = spark.createDataFrame([("d", 1, "7", 1, 2), ("d", 2, "Annex B", 1, 1)], "spec_id string, ord int, section string, page int, end_page int")
    e = fixture_elements(spark).withColumn("text", F.when(F.col("text") == "Bare", "Annex B: bare").otherwise(F.col("text")))
    return content.section_content(e, secs).select("section", "page", "elem_ord", "type")


BLOCK_TAGS = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li', 'pre'"
BARE = "html"
for _tag in ("script", "style", "head", "nav"):  # one after the other, as this dialect has no back references
    BARE = f"regexp_replace({BARE}, '(?is)<{_tag}(\\s[^>]*)?>.*?</{_tag}\\s*>', '', 'g')"
HTML_SQL = f"""
WITH clean AS (SELECT page_id, string_split({BARE}, '<') AS cuts FROM pages
), cut AS (SELECT page_id, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS n FROM clean
), tag AS (SELECT page_id, n, lower(regexp_extract(cut, '^(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag, regexp_replace(cut, '^[^>]*>', '') AS text FROM cut WHERE n > 0
), run AS (SELECT *, sum(CASE WHEN regexp_replace(tag, '^/', '') IN ({BLOCK_TAGS}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM tag
), block AS (SELECT page_id, run, arg_min(tag, n) AS tag, trim(regexp_replace(string_agg(text, '' ORDER BY n), '\\s+', ' ', 'g'), ' ') AS text FROM run WHERE run > 0 GROUP BY page_id, run
), kept AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY run) AS INT) AS elem_ord, tag, text FROM block WHERE text <> '' AND NOT starts_with(tag, '/'))
"""


@query(HTML_SQL + "SELECT page_id, elem_ord, tag, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' WHEN tag = 'pre' THEN 'code' ELSE 'paragraph' END AS type, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INT) END AS level, text FROM kept")
def html_elements(spark, sf_dir):
    return html.elements(table(spark, sf_dir, "pages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' ') AS title FROM pages")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(HTML_SQL + "SELECT tag AS role, count(*) AS n FROM kept GROUP BY tag")
def role_histogram(spark, sf_dir):
    return profile.role_histogram(html.elements(table(spark, sf_dir, "pages")).withColumnRenamed("tag", "role"))


# --- requirements, definitions, tables ----------------------------------------------------------------------------------

COMMON = ("that", "was", "with", "is")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select(F.col("lang").alias("spec_id"), F.col("source").alias("section"), (F.col("doc_id") * 100000 + F.col("n")).alias("elem_ord"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("array<string>").alias("items"))


REQUIRED = """
WITH line AS (
  SELECT lang AS spec_id, source AS section, doc_id * 100000 + generate_subscripts(lines, 1) - 1 AS elem_ord, unnest(lines) AS text FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)
), piece AS (
  SELECT spec_id, section, elem_ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT *, string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS parts FROM line)
), begun AS (
  SELECT *, CASE WHEN regexp_matches(lag(part) OVER w, '[0-9][.!?]$') THEN 0 ELSE 1 END AS begins FROM piece WINDOW w AS (PARTITION BY elem_ord ORDER BY i)
), grouped AS (SELECT *, sum(begins) OVER (PARTITION BY elem_ord ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM begun
), sentence AS (
  SELECT *, regexp_replace(string_agg(part, '') OVER (PARTITION BY elem_ord, g ORDER BY i ROWS UNBOUNDED PRECEDING), '^\\s+|\\s+$', '', 'g') AS sentence FROM grouped
), hit AS (
  SELECT s.*, k.word AS level, length(regexp_extract(lower(part), '^((?s).*?)(?:^|[^a-z0-9_])' || k.word || '(?:[^a-z0-9_]|$)', 1)) AS spot
  FROM sentence s, (VALUES ('that'), ('was'), ('with'), ('is')) k(word) WHERE regexp_matches(lower(part), '(^|[^a-z0-9_])' || k.word || '([^a-z0-9_]|$)')
), once AS (SELECT spec_id, section, elem_ord, level, sentence, min(i * 1000000 + spot) AS n FROM hit GROUP BY ALL
), numbered AS (SELECT *, row_number() OVER (PARTITION BY spec_id, section ORDER BY elem_ord, n) AS number FROM once)
"""


@query(REQUIRED + "SELECT spec_id, section, 'R-' || section || '-' || number AS id, level, sentence AS text FROM numbered")
def requirements_extract(spark, sf_dir):
    return requirements.extract(document_lines(spark, sf_dir), COMMON).select("spec_id", "section", "id", "level", "text")


@query(REQUIRED + "SELECT spec_id, level, count(*) AS n FROM numbered GROUP BY ALL")
def requirements_stats(spark, sf_dir):
    return requirements.statistics(requirements.found(document_lines(spark, sf_dir), COMMON))


@query(REQUIRED + "SELECT id, text FROM (SELECT 'R-' || section || '-' || number AS id, level, sentence AS text, spec_id FROM numbered) WHERE level = 'with' AND spec_id = 'en'")
def requirements_level(spark, sf_dir):
    return requirements.extract(document_lines(spark, sf_dir).where("spec_id = 'en'"), COMMON).where("level = 'with'").select("id", "text")


@fixed(fx.values(
    "id, level, text",
    ("R-7.1-1", "shall", "A writer shall close files."), ("R-7.1-2", "should not", "A reader should not guess; it may ask."), ("R-7.1-3", "may", "A reader should not guess; it may ask."), ("R-7.1-4", "shall", "In 2020. Readers shall wait"), ("R-7.1-5", "shall", "Shall we?"), ("R-7.1-6", "shall not", "It shall not."), ("R-7.1-7", "may", "See 3.14 and may."), ("R-7.2-1", "shall", "Version 2.0 shall apply!"), ("R-7.2-2", "should", "Files SHOULD end."),
))
def requirements_default(spark, sf_dir):
    rows = spark.sql(fx.SHALL).withColumn("items", F.lit(None).cast("array<string>"))
    return requirements.extract(rows).select("id", "level", "text")


def fixture_terms(spark: SparkSession) -> DataFrame:
    items = F.when((F.col("spec_id") == "d") & (F.col("elem_ord") == 2), F.lit(None)).cast("array<string>")
    index = spark.createDataFrame([("d", 2, "list", None, None, ["3.1\n3.2", "3.3"])], "spec_id string, elem_ord int, type string, text string, label string, items array<string>")
    return spark.sql(fx.TERMS).withColumn("items", items).unionByName(index)


@fixed(fx.DEFINITIONS)
def definitions_parse(spark, sf_dir):
    return definitions.extract(fixture_terms(spark)).select("spec_id", "number", "term", "definition", "section", joined(F.col("notes")).alias("notes"), "source")


@fixed(f"SELECT term, definition FROM ({fx.DEFINITIONS}) WHERE contains(lower(term), 'table') OR contains(lower(definition), 'table')")
def definitions_matching(spark, sf_dir):
    return definitions.matching(definitions.extract(fixture_terms(spark)), "TABLE").select("term", "definition")


def fixture_tables(spark: SparkSession) -> DataFrame:
    split = F.when(F.col("headers") == "", F.array().cast("array<string>")).otherwise(F.split("headers", "\\|"))
    rows = F.transform(F.split("cells", "/"), lambda r: F.split(r, "\\|"))
    return spark.sql(fx.TABLES).withColumns({"headers": split, "rows": rows}).drop("cells")


def shown(found: DataFrame) -> DataFrame:
    return found.select("section", "index", "caption", joined(F.col("headers")).alias("headers"), F.array_join(F.transform("rows", lambda r: joined(r)), "/").alias("cells"))


@fixed(fx.TABLES_READ)
def tables_read(spark, sf_dir):
    return shown(tables.section_tables(fixture_tables(spark)))


@fixed(f"SELECT * FROM ({fx.TABLES_READ}) WHERE section = '1' AND \"index\" = 1")
def table_pick(spark, sf_dir):
    return shown(tables.section_tables(fixture_tables(spark))).where("section = '1' AND index = 1")


# --- two versions -------------------------------------------------------------------------------------------------------

def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    side = F.when(F.col("page_id") % 2 == 0, "old").otherwise("new")
    number = F.concat((F.col("page_id") % 10).cast("string"), F.lit("."), F.col("page_id").cast("string"))
    return pages.select(side.alias("spec_id"), F.col("page_id").alias("ord"), number.alias("section"), html.title(F.col("html")).alias("title"), F.lit(None).cast("string").alias("parent"))


COMPARED = """
WITH sec AS (
  SELECT page_id AS ord, page_id % 2 = 1 AS is_new, (page_id % 10) || '.' || page_id AS section, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' ') AS title FROM pages
), norm AS (SELECT *, regexp_replace(regexp_replace(lower(title), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS norm FROM sec
), target AS (SELECT norm, arg_min(section, ord) AS to_section, arg_min(title, ord) AS to_title FROM norm WHERE is_new AND norm <> '' GROUP BY norm
), asked AS (SELECT o.*, t.to_section, t.to_title, row_number() OVER (PARTITION BY t.to_section ORDER BY o.ord) AS turn FROM norm o LEFT JOIN target t USING (norm) WHERE NOT o.is_new AND o.norm <> ''
), compared AS (
  SELECT 'matched' AS kind, section AS old_section, to_section AS new_section, to_title AS title, CASE WHEN section = to_section THEN 'same' ELSE 'moved' END AS status FROM asked WHERE to_section IS NOT NULL AND turn = 1
  UNION ALL SELECT 'removed', section, NULL, title, NULL FROM asked WHERE to_section IS NULL OR turn > 1
  UNION ALL SELECT 'added', NULL, section, title, NULL FROM norm WHERE is_new AND section NOT IN (SELECT to_section FROM asked WHERE to_section IS NOT NULL AND turn = 1)
)
"""


@query(COMPARED + "SELECT * FROM compared")
def compare_versions(spark, sf_dir):
    return compare.compare(page_versions(spark, sf_dir), "old", "new").drop("ord")


@query(COMPARED + "SELECT * FROM compared WHERE starts_with(old_section, '4.') OR starts_with(new_section, '4.')")
def compare_within(spark, sf_dir):
    return compare.within(compare.compare(page_versions(spark, sf_dir), "old", "new"), "4").drop("ord")


@query("""
WITH sec AS (SELECT page_id AS ord, page_id % 2 = 1 AS is_new, (page_id % 10) || '.' || page_id AS section, regexp_replace(trim(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ' '), '\\s+', ' ', 'g') AS norm FROM pages)
SELECT o.norm, o.section AS old_section, n.section AS new_section FROM (SELECT norm, arg_max(section, ord) AS section FROM sec WHERE NOT is_new AND norm <> '' GROUP BY norm) o
JOIN (SELECT norm, arg_max(section, ord) AS section FROM sec WHERE is_new AND norm <> '' GROUP BY norm) n USING (norm)""")
def title_overlap(spark, sf_dir):
    both = page_versions(spark, sf_dir)
    return profile.title_overlap(both.where("spec_id = 'old'"), both.where("spec_id = 'new'"))


# --- registry and profiles ----------------------------------------------------------------------------------------------

FOUND = fx.values(
    "spec_id, filename, category",
    ("iso32000-2", "ISO_32000-2_sponsored-ec2.pdf", "standard"), ("pdf17", "PDF32000_2008.pdf", "standard"), ("ts32001", "ISO_TS_32001-2022.pdf", "ts"), ("ts32004", "iso-ts-32004.pdf", "ts"), ("tagged-bpg", "Tagged-PDF-Best-Practice.pdf", "guide"), ("an002", "PDF20_AN002-af.pdf", "appnote"), ("pdfua2", "ISO-14289-2-2024.pdf", "pdfua"),
)


@fixed(FOUND)
def registry_classify(spark, sf_dir):
    return registry.classify(spark.sql(fx.FILES), registry.rules(spark)).select("spec_id", "filename", "category")


@fixed(f"SELECT * FROM ({FOUND}) WHERE category = 'ts'")
def list_by_category(spark, sf_dir):
    return registry.list_specs(registry.classify(spark.sql(fx.FILES), registry.rules(spark)), "ts").select("spec_id", "filename", "category")


@fixed(fx.values("format, n", ("dotted", 3), ("plain", 1), ("dot-ended", 2), ("annex", 4), ("appendix", 1), ("none", 3)))
def number_formats(spark, sf_dir):
    return profile.number_formats(spark.sql(fx.TITLES))


@query("SELECT lang AS spec_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, min(length(text)) AS shortest, max(length(text)) AS longest, arg_min(substr(text, 1, 200), doc_id) FILTER (WHERE regexp_matches(text, '\\S')) AS sample FROM documents GROUP BY lang")
def text_profile(spark, sf_dir):
    return profile.text_profile(document_pages(spark, sf_dir))


@query("SELECT lang AS spec_id, count(*) FILTER (WHERE contains(text, chr(9))) AS tabs, count(*) FILTER (WHERE contains(text, chr(8203)) OR contains(text, chr(65279))) AS invisible, count(*) FILTER (WHERE contains(text, '  ')) AS double_spaces FROM documents GROUP BY lang")
def special_characters(spark, sf_dir):
    return profile.special_characters(document_pages(spark, sf_dir))


@fixed(f"SELECT name, ms AS now_ms, base_ms, CASE WHEN base_ms > 0 THEN (ms - base_ms) * 100.0 / base_ms ELSE 0.0 END::DOUBLE AS change, base_ms > 0 AND (ms - base_ms) * 100.0 / base_ms > 20 AS slower FROM (SELECT name, ms::DOUBLE AS ms, base_ms::DOUBLE AS base_ms FROM ({fx.TIMINGS}))")
def regressions(spark, sf_dir):
    t = spark.sql(fx.TIMINGS).select("name", F.col("ms").cast("double").alias("ms"), F.col("base_ms").cast("double").alias("base_ms"))
    return profile.regressions(t.select("name", "ms"), t.select("name", F.col("base_ms").alias("ms")))

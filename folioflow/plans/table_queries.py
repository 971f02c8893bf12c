"""Queries of content, definitions, tables, registry and profiles over inputs that are derived from whole tables, with their SQL.

Parts stand for blocks of pages (twenty to a page), customers for terms, nations for documents. The SQL says what must come
out from the tables themselves; it does not go through nodes and text items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import compare, content, definitions, outline, profile, search, tables
from folioflow.plans import fixtures as fx
from folioflow.plans.queries import GEO, document_pages, flat, geography, joined, query, search_sql, shown, table
from folioflow.sources import canonical, registry

# --- pages of parts: headings, paragraphs, notes, lists and tables in turn -------------------------------------------------

#: How a block is tagged: (kind, node, parent, sib, role, piece, says, level); ``says`` names the text of a leaf.
BLOCK = fx.values(
    "kind, node, parent, sib, role, piece, says, level",
    (0, 1, 0, 0, "H2", None, None, 1), (0, 2, 1, 0, None, "a", "heading", 2), (0, 3, 1, 1, "Artifact", None, None, 2), (0, 4, 3, 0, None, "x", "brand", 3),
    (1, 1, 0, 0, "P", None, None, 1), (1, 2, 1, 0, None, "a", "brand", 2), (1, 3, 1, 1, "Span", None, None, 2), (1, 4, 3, 0, None, "b", "type", 3),
    (2, 1, 0, 0, "Sect", None, None, 1), (2, 2, 1, 0, "P", None, None, 2), (2, 3, 2, 0, None, "a", "note", 3),
    (3, 1, 0, 0, "L", None, None, 1), (3, 2, 1, 0, "LI", None, None, 2), (3, 3, 2, 0, "Lbl", None, None, 3), (3, 4, 3, 0, None, "x", "brand", 4), (3, 5, 2, 1, "LBody", None, None, 3), (3, 6, 5, 0, None, "a", "name", 4), (3, 7, 1, 1, "LI", None, None, 2), (3, 8, 7, 0, None, "b", "type", 3),
    (4, 1, 0, 0, "Table", None, None, 1), (4, 2, 1, 0, "THead", None, None, 2), (4, 3, 2, 0, "TR", None, None, 3), (4, 4, 3, 0, "TH", None, None, 4), (4, 5, 4, 0, None, "a", "name", 5), (4, 6, 3, 1, "TH", None, None, 4), (4, 7, 6, 0, None, "b", "type", 5),
    (4, 8, 1, 1, "TBody", None, None, 2), (4, 9, 8, 0, "TR", None, None, 3), (4, 10, 9, 0, "TD", None, None, 4), (4, 11, 10, 0, None, "c", "brand", 5), (4, 12, 9, 1, "TD", None, None, 4), (4, 13, 8, 1, "TR", None, None, 3),
)
#: What pieces say, in SQL that Spark and DuckDB share.
SAYS = "CASE says WHEN 'heading' THEN concat(p_partkey, ' ', p_name) WHEN 'brand' THEN concat(p_brand, ' ') WHEN 'type' THEN p_type WHEN 'note' THEN concat('NOTE ', p_size, '  ', p_name) ELSE p_name END"


def part_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("kind", (F.col("p_partkey") % 5).cast("int"))
    rows = parts.join(F.broadcast(spark.sql(BLOCK)), "kind")
    at = (F.col("p_partkey") % 20).cast("int")
    page = (F.floor(F.col("p_partkey") / 20) + 1).cast("int")
    return rows.select(F.concat(F.lit("s"), page % 4).alias("spec_id"), page.alias("page"), at.alias("at"), "node", "parent", "sib", "role", F.concat(at, "piece").alias("content_id"), F.expr(SAYS).alias("str"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_pieces(spark, sf_dir)
    top = rows.select("spec_id", "page").distinct().select("spec_id", "page", F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("sib_ord"), F.lit("Document").alias("role"), F.lit(None).cast("string").alias("content_id"))
    number = (F.col("at") + 1) * 100
    below = rows.select("spec_id", "page", (number + F.col("node")).cast("bigint"), F.when(F.col("parent") > 0, number + F.col("parent")).otherwise(0).cast("bigint"), F.when(F.col("parent") > 0, F.col("sib")).otherwise(F.col("at")), "role", "content_id")
    return top.union(below)


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = part_pieces(spark, sf_dir).where("content_id IS NOT NULL")
    event = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(("begin_props", "text", "end"))])).alias("e")
    rows = leaves.select("*", event)
    is_text = F.col("e.kind") == "text"
    return rows.select("spec_id", "page", (F.col("at") * 100 + F.col("node") * 3 + F.col("e.i")).alias("seq"), F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "begin_props", F.col("content_id")).alias("content_id"), F.when(is_text, F.col("str")).alias("str"), F.when(is_text, F.lit(False)).alias("has_eol"))


def part_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_elements(part_nodes(spark, sf_dir), part_items(spark, sf_dir))


PARTS = """
WITH part_ AS (SELECT *, p_partkey // 20 + 1 AS page, p_partkey % 5 AS kind FROM part
), element AS (
  SELECT p_partkey, 's' || page % 4 AS spec_id, page, row_number() OVER (PARTITION BY page ORDER BY p_partkey) AS elem_ord,
    ['heading', 'paragraph', 'note', 'list', 'table'][kind + 1] AS type, CASE WHEN kind = 0 THEN 2 END AS level,
    CASE kind WHEN 0 THEN p_partkey || ' ' || p_name WHEN 1 THEN p_brand || ' ' || p_type WHEN 2 THEN p_name END AS text, CASE WHEN kind = 2 THEN 'NOTE ' || p_size END AS label,
    CASE WHEN kind = 3 THEN p_name || '|' || p_type END AS items, CASE WHEN kind = 4 THEN p_name || '|' || p_type END AS headers, CASE WHEN kind = 4 THEN p_brand || '|' END AS cells FROM part_
)
"""


@query(PARTS + "SELECT spec_id, page, elem_ord, type, level, text, label, items, headers, cells FROM element")
def content_elements(spark, sf_dir):
    e = part_elements(spark, sf_dir)
    return e.select("spec_id", "page", "elem_ord", "type", "level", "text", "label", *flat(e))


@query(f"SELECT p_partkey // 20 + 1 AS page, (p_partkey % 20) || piece AS content_id, {SAYS} AS text FROM part JOIN ({BLOCK}) b ON b.kind = p_partkey % 5 WHERE piece IS NOT NULL")
def content_marked_text(spark, sf_dir):
    return content.marked_text(part_items(spark, sf_dir)).select("page", "content_id", "text")


@query(PARTS + """SELECT s.p_partkey || '' AS section, e.page, row_number() OVER (PARTITION BY s.p_partkey ORDER BY e.page, e.elem_ord) AS elem_ord, e.type, e.text
FROM element s JOIN element e ON e.spec_id = s.spec_id AND e.page = s.page AND e.elem_ord >= s.elem_ord WHERE s.type = 'heading'""")
def content_sections(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    page = (F.floor(F.col("p_partkey") / 20) + 1).cast("int")
    secs = parts.select(F.concat(F.lit("s"), page % 4).alias("spec_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("section"), page.alias("page"), page.alias("end_page"))
    return content.section_content(part_elements(spark, sf_dir), secs).select("section", "page", "elem_ord", "type", "text")


@query(f"SELECT 's' || (p_partkey // 20 + 1) % 4 AS spec_id, bool_or(role = 'Table') AS has_table, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM (SELECT p_partkey, role FROM part JOIN ({BLOCK}) b ON b.kind = p_partkey % 5 WHERE level <= 2 UNION ALL SELECT p_partkey, 'Document' FROM part) GROUP BY ALL")
def roles_to_depth(spark, sf_dir):
    return profile.has_tables(part_nodes(spark, sf_dir), 2).select("spec_id", "has_table", joined(F.col("roles")).alias("roles"))


# --- page text and search -----------------------------------------------------------------------------------------------

def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text items, with events between them that are no text."""
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit("begin").alias("kind"), F.lit(None).cast("string").alias("str")), F.struct(F.lit(1).alias("i"), F.lit("text").alias("kind"), F.col("line").alias("str"))))
    return lines.select(F.col("lang").alias("spec_id"), F.col("doc_id").alias("page"), "n", both.alias("e")).select("spec_id", "page", (F.col("n") * 2 + F.col("e.i")).alias("seq"), "e.kind", F.lit(None).cast("string").alias("content_id"), "e.str", F.lit(False).alias("has_eol"))


@query("SELECT lang AS spec_id, doc_id AS page, md5(replace(text, chr(10), ' ')) AS text FROM documents WHERE text IS NOT NULL")
def page_text_build(spark, sf_dir):
    return search.page_text(document_items(spark, sf_dir)).select("spec_id", "page", F.md5("text").alias("text"))


@query(search_sql("that with", ["that", "with"], 5))
def search_indexed(spark, sf_dir):
    return search.search(search.index(document_pages(spark, sf_dir)), "that with", 5)


FIVES = "SELECT ord, 'S' || ord AS section, 'Title ' || (ord % 7) AS title, ord * 10 AS page FROM (SELECT s_suppkey AS ord FROM supplier)"


@query(f"""WITH sec AS ({FIVES}), hit AS (
  SELECT d.lang AS spec_id, d.doc_id AS page, (length(nt) - length(replace(nt, 'the', ''))) // 3 AS score, coalesce(s.section, '') AS section, coalesce(s.title, '') AS title
  FROM (SELECT *, lower(replace(text, chr(10), ' ')) AS nt FROM documents) d ASOF LEFT JOIN sec s ON d.doc_id >= s.page WHERE contains(nt, 'the')
), best AS (SELECT *, row_number() OVER (PARTITION BY spec_id, CASE WHEN section = '' THEN 'page:' || page ELSE section END ORDER BY score DESC, page) AS n FROM hit)
SELECT spec_id, section, title, page, 3 * score AS score FROM best WHERE n = 1""")
def search_titles(spark, sf_dir):
    secs = supplier_sections(spark, sf_dir)
    return search.with_titles(search.search(document_index(spark, sf_dir, secs), "the", None), secs).select("spec_id", "section", "title", "page", "score")


def supplier_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the outline of each language's document."""
    languages = [r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]
    each = F.explode(F.array(*map(F.lit, languages)).cast("array<string>")).alias("spec_id")
    return table(spark, sf_dir, "supplier").select(each, F.col("s_suppkey").alias("ord"), F.concat(F.lit("S"), "s_suppkey").alias("section"), F.concat(F.lit("Title "), F.col("s_suppkey") % 7).alias("title"), (F.col("s_suppkey") * 10).alias("page"))


def document_index(spark: SparkSession, sf_dir: str, secs: DataFrame) -> DataFrame:
    """The search index of the documents, put together from their text items and the sections."""
    return search.index(outline.page_sections(search.page_text(document_items(spark, sf_dir)), secs))


# --- terms of customers, tables of parts --------------------------------------------------------------------------------

@query("""SELECT 'n' || c_nationkey AS spec_id, row_number() OVER w AS number, c_name AS term, 'Belongs to ' || c_mktsegment || '.' || CASE WHEN c_custkey % 3 = 1 THEN ' [SOURCE: ledger, ' || c_custkey || ']' ELSE '' END AS definition,
  '3.' || row_number() OVER w AS section, CASE WHEN c_custkey % 3 = 0 THEN 'NOTE 1: has key ' || c_custkey END AS notes, CASE WHEN c_custkey % 3 = 1 THEN 'ledger, ' || c_custkey END AS source FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def definitions_table(spark, sf_dir):
    key = F.col("c_custkey")
    no = F.lit(None).cast("string")

    def element(i: int, kind: str, text, label=no):  # noqa: ANN001, ANN202
        return F.struct((key * 4 + i).alias("elem_ord"), F.lit(kind).alias("type"), text.alias("text"), label.alias("label"))

    last = F.when(key % 3 == 0, element(3, "note", F.concat(F.lit("has key "), key), F.lit("NOTE 1"))).when(key % 3 == 1, element(3, "paragraph", F.concat(F.lit("[SOURCE: ledger, "), key, F.lit("]"))))
    rows = F.array(element(0, "paragraph", F.concat(F.lit("3."), key)), element(1, "paragraph", F.col("c_name")), element(2, "paragraph", F.concat(F.lit("Belongs to "), "c_mktsegment", F.lit("."))), last)
    elements = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("spec_id"), F.explode(F.array_compact(rows)).alias("e")).select("spec_id", "e.*", F.lit(None).cast("array<string>").alias("items"))
    return definitions.extract(elements).select("spec_id", "number", "term", "definition", "section", joined(F.col("notes")).alias("notes"), "source")


@query("""WITH t AS (SELECT p_brand AS section, p_partkey AS k, p_partkey % 3 = 0 AS cap, CASE WHEN p_size % 2 = 0 THEN 'name|size' ELSE 'name|type' END AS h, p_name || '|' || CASE WHEN p_size % 2 = 0 THEN p_size || '' ELSE p_type END AS line FROM part
), again AS (SELECT *, NOT cap AND coalesce(lag(h) OVER (PARTITION BY section ORDER BY k) = h, false) AS again FROM t
), numbered AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY section ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS "index" FROM again)
SELECT section, CAST("index" AS INT) AS "index", CASE WHEN arg_min(cap, k) THEN 'Table ' || min(k) || ' of parts' END AS caption, arg_min(h, k) AS headers, string_agg(line, '/' ORDER BY k) AS cells FROM numbered GROUP BY section, "index" """)
def tables_table(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    no = F.lit(None)
    head = F.when(even, F.array(F.lit("name"), F.lit("size"))).otherwise(F.array(F.lit("name"), F.lit("type")))
    line = F.array("p_name", F.when(even, F.col("p_size").cast("string")).otherwise(F.col("p_type")))
    caption = F.when(F.col("p_partkey") % 3 == 0, F.struct(F.lit(0).alias("i"), F.lit("paragraph").alias("type"), F.concat(F.lit("Table "), "p_partkey", F.lit(" of parts")).alias("text"), no.cast("array<string>").alias("headers"), no.cast("array<array<string>>").alias("rows")))
    body = F.struct(F.lit(1).alias("i"), F.lit("table").alias("type"), no.cast("string").alias("text"), head.alias("headers"), F.array(line).alias("rows"))
    rows = table(spark, sf_dir, "part").select(F.lit("d").alias("spec_id"), F.col("p_brand").alias("section"), "p_partkey", F.explode(F.array_compact(F.array(caption, body))).alias("e"))
    return shown(tables.section_tables(rows.select("spec_id", "section", (F.col("p_partkey") * 2 + F.col("e.i")).alias("elem_ord"), "e.type", "e.text", "e.headers", "e.rows")))


# --- registry, destinations, profiles, contexts -------------------------------------------------------------------------

@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'ISO_TS_3200' || (1 + p_size % 3) || '-' || p_partkey || '.pdf' WHEN 1 THEN 'copy-' || p_partkey || '-PDF20_AN00' || (1 + p_size % 3) || '.PDF' WHEN 2 THEN 'PDF20_AN001-' || p_partkey || '.txt' ELSE p_name || '.pdf' END AS filename, p_partkey % 4 AS kind, 1 + p_size % 3 AS n FROM part)
SELECT CASE kind WHEN 0 THEN 'ts3200' || n ELSE 'an00' || n END AS spec_id, min(filename) AS filename, CASE kind WHEN 0 THEN 'ts' ELSE 'appnote' END AS category FROM f WHERE kind < 2 GROUP BY kind, n""")
def registry_files(spark, sf_dir):
    n, k = (1 + F.col("p_size") % 3), F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("ISO_TS_3200"), n, F.lit("-"), k, F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("copy-"), k, F.lit("-PDF20_AN00"), n, F.lit(".PDF")))
    name = name.when(k % 4 == 2, F.concat(F.lit("PDF20_AN001-"), k, F.lit(".txt"))).otherwise(F.concat("p_name", F.lit(".pdf")))
    return registry.classify(table(spark, sf_dir, "part").select(name.alias("filename"))).select("spec_id", "filename", "category")


@query("""SELECT n_name AS spec_id, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE s.pages END AS pages, s.entries AS outline_entries FROM nation
LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS INT) AS pages, CAST(count(DISTINCT c_mktsegment) AS INT) AS entries FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY ALL) s ON c_nationkey = n_nationkey""")
def registry_enrich(spark, sf_dir):
    no = F.lit(None).cast("int")
    specs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("spec_id"), F.when(F.col("n_nationkey") % 2 == 0, 7).alias("pages"), no.alias("outline_entries"))
    counted = table(spark, sf_dir, "customer").where("c_nationkey % 5 <> 0").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("pages"), F.count_distinct("c_mktsegment").cast("int").alias("outline_entries"))
    stats = counted.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("spec_id"), "pages", "outline_entries")
    return registry.enrich(specs, stats)


@query("SELECT c_custkey AS entry_id, CASE WHEN c_nationkey % 6 = 5 OR c_custkey % 11 = 0 THEN -1 ELSE c_nationkey * 10 + 1 END AS page FROM customer")
def resolve_destinations(spark, sf_dir):
    dest = F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("dest"), "c_nationkey"))
    entries = table(spark, sf_dir, "customer").select(F.lit("d").alias("spec_id"), F.col("c_custkey").alias("entry_id"), dest.alias("dest"))
    dests = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(F.lit("d").alias("spec_id"), F.concat(F.lit("dest"), "n_nationkey").alias("dest"), (F.col("n_nationkey") * 10).alias("page_index"))
    return canonical.resolve(entries, dests).select("entry_id", "page")


@query(GEO + "SELECT 'world' AS spec_id, count(*) AS entries, count(*) FILTER (WHERE n IS NULL) AS top_level, max(CASE WHEN n IS NULL THEN 0 WHEN c IS NULL THEN 1 ELSE 2 END) AS max_depth, count(*) FILTER (WHERE page < 1) AS unresolved FROM entry")
def outline_profile(spark, sf_dir):
    return profile.outline_profile(outline.tree_rows(geography(spark, sf_dir)[0]))


@query("""SELECT s.spec_id, count(d.doc_id) FILTER (WHERE d.lang IS NOT NULL) AS pages, count(*) FILTER (WHERE contains(d.text, chr(9))) AS tabs, count(d.doc_id) = 0 AS failed
FROM (SELECT DISTINCT lang AS spec_id FROM documents UNION ALL SELECT 'zz') s LEFT JOIN documents d ON d.lang = s.spec_id GROUP BY s.spec_id""")
def profile_summary(spark, sf_dir):
    pages = document_pages(spark, sf_dir)
    specs = pages.select("spec_id").distinct().unionByName(spark.createDataFrame([("zz",)], "spec_id string"))
    both = profile.summary(specs, profile.text_profile(pages), profile.special_characters(pages))
    return both.select("spec_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("tabs", F.lit(0)).alias("tabs"), "failed")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer
), target AS (SELECT n, seg, min(k) AS k FROM c WHERE k % 2 = 1 GROUP BY ALL
), lone AS (SELECT seg FROM c WHERE k % 2 = 1 GROUP BY seg HAVING count(*) = 1
), asked AS (SELECT c.*, t.k AS tk, row_number() OVER (PARTITION BY t.k ORDER BY c.k) AS turn FROM c LEFT JOIN target t ON t.n = c.n AND t.seg = c.seg WHERE c.k % 2 = 0 AND c.seg NOT IN (SELECT seg FROM lone)
), pair AS (SELECT * FROM asked WHERE tk IS NOT NULL AND turn = 1)
SELECT 'matched' AS kind, 'c' || k AS old_section, 'c' || tk AS new_section, seg AS title, 'moved' AS status FROM pair
UNION ALL SELECT 'removed', 'c' || k, NULL, seg, NULL FROM asked WHERE tk IS NULL OR turn > 1
UNION ALL SELECT 'added', NULL, 'c' || k, seg, NULL FROM c WHERE k % 2 = 1 AND k NOT IN (SELECT tk FROM pair)
UNION ALL SELECT 'matched', 'n' || n_nationkey, 'n' || n_nationkey, n_name, 'same' FROM nation""")
def compare_contexts(spark, sf_dir):
    """Sections whose titles repeat, told apart by their parents."""
    customers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "old").otherwise("new").alias("spec_id"), (F.col("c_custkey") + 1000).alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("section"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.explode(F.array(F.lit("old"), F.lit("new"))).alias("spec_id"), F.col("n_nationkey").cast("bigint").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("section"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("parent"))
    return compare.compare(nations.unionByName(customers), "old", "new").drop("ord")

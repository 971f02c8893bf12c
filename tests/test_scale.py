"""What must hold for large tables: shapes of plans, and results where rows are dealt to many tasks."""

import duckdb
import pyarrow as pa

import __spark_entry__ as entry
from folioflow.operators import compare, content, grams, outline
from folioflow.sources import canonical, markup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_do_not_carry_their_page(spark):
    pages = spark.createDataFrame([("d", 1, "<p>a<p>b")], "spec_id string, page int, html string")
    above = plan(markup.tags(pages)).split("Generate posexplode")[0]
    assert above and "html" not in above


def test_walks_do_not_broadcast_a_table(spark):
    nodes, items, entries = (spark.createDataFrame([], canonical.SCHEMAS[t]) for t in ("struct_nodes", "text_items", "outline_entries"))
    stats = spark.createDataFrame([], canonical.SCHEMAS["doc_stats"])
    for df in (content.page_elements(nodes, items), outline.sections(entries, stats), outline.tree_rows(entries)):
        text = df._jdf.queryExecution().analyzed().toString()
        assert "strategy=merge" in text


def test_headings_that_begin_with_numbers_are_whole_titles(spark, tmp_path):
    heads = ["4501 Anth heoron", "Plain", "56.187.231.175 Keit", "7. Dotted"]
    pages = [(4 * i, "u", f"<html><body><article><h1>{h}</h1><p>text</p></article></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()["html_sections"])
    got = entry.queries()["html_sections"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_lists_of_grams_are_made_where_texts_are_read():
    batch = pa.RecordBatch.from_pydict({"span": ["s"] * 50 + ["t"], "place": [*range(50), 0], "norm": ["abcab"] * 49 + ["ab"] + ["ab"]})
    rows = [r for b in grams._lists(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == len({(r["gram"], r["span"]) for r in rows}) == 7
    assert {r["gram"]: r["places"] for r in rows if r["span"] == "s"} == {"abc": [*range(49)], "bca": [*range(49)], "cab": [*range(49)], "ab": [*range(50)], "b": [*range(50)]}


def test_walks_are_dealt_by_all_rows(spark):
    nodes = spark.range(4000).selectExpr("'d' spec_id", "1 page", "id node_id", "CASE WHEN id > 0 THEN 0L END parent_id", "int(id) sib_ord", "IF(id = 0, 'Document', 'P') role", "string(null) content_id")
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        walk = content._walk(nodes)
        assert walk.count() == 3999 and walk.rdd.getNumPartitions() > 1
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_a_long_document_is_numbered_by_ranges(spark):
    n = 3000
    rows = spark.range(n).selectExpr("'d' spec_id", "id entry_id", "CASE WHEN id % 3 > 0 THEN id - id % 3 END parent_id", "int(id) sib_ord", "concat('t', id) title", "int(id * 2 + 1) page").unionAll(spark.sql("SELECT 'e', 7L, NULL, 1, 'alone', 5"))
    stats = spark.createDataFrame([("d", 9999), ("e", 6)], "spec_id string, total_pages int")
    secs = outline.sections(rows, stats)
    got = sorted(tuple(r) for r in secs.select("spec_id", "ord", "section", "page", "end_page").collect())
    assert got == [*[("d", i + 1, f"t{i}", 2 * i + 1, 2 * i + 2 if i < n - 1 else 9999) for i in range(n)], ("e", 1, "alone", 5, 6)]
    for part in plan(secs).split("Window [")[1:]:
        keys = part.split("\n")[0].split("], [")[1]
        assert "," in keys  # never by document alone


def test_a_tree_is_walked_once_for_all_its_levels(spark):
    rows = spark.createDataFrame([("d", 1, None, 1, "1 a", 1), ("d", 2, 1, 1, "1.1 b", 2)], canonical.SCHEMAS["outline_entries"])
    nested = outline.nested(outline.tree_rows(rows))
    assert "UnionLoop" not in plan(nested)
    assert '"children":[{"title":"1.1 b"' in nested.first().tree


def test_a_preview_does_not_broadcast_contents(spark):
    compared = spark.createDataFrame([("matched", "1", "7")], "kind string, old_section string, new_section string")
    side = spark.createDataFrame([("1", 1, "a")], "section string, elem_ord int, text string")
    assert plan(compare.preview(compared, side, side)).count("strategy=merge") >= 2

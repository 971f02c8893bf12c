import json

import pytest

from folioflow.engine import Engine
from folioflow.functions.errors import ContentError, PrerequisiteError, RegistryError
from folioflow.operators import content, outline
from folioflow.plans import fixtures as fx
from folioflow.sources import canonical, html, registry
from folioflow.streaming.pages import append_page_text

SPECS = [("v2", "Version two", "v2.pdf"), ("pdf17", "Version one", "v1.pdf")]


def page(spec, number, blocks, first=1):
    """A page's nodes and items of (role, text) blocks."""
    nodes = [(spec, number, 0, None, 0, "Document", None)]
    items = []
    for i, (role, text) in enumerate(blocks):
        nodes += [(spec, number, 10 * i + 1, 0, i, role, None), (spec, number, 10 * i + 2, 10 * i + 1, 0, None, f"m{i}")]
        items += [(spec, number, 3 * i, "begin_props", f"m{i}", None, None), (spec, number, 3 * i + 1, "text", None, text, False), (spec, number, 3 * i + 2, "end", None, None, None)]
    return nodes, items


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    pages = {
        ("v2", 1): [("H1", "1 Scope"), ("P", "A scope that shall hold. Font files may differ.")],
        ("v2", 2): [("H1", "2 Fonts"), ("P", "About a font. A font shall not lie."), ("H2", "2.1 Glyphs"), ("P", "Glyph and font. A glyph should fit."), ("P", "Table 1 - Kinds"), ("P", "Kind  Use"), ("P", "one  two")],
        ("v2", 3): [("H1", "3 Terms"), ("P", "3.1"), ("P", "glyph"), ("P", "a drawn shape."), ("H1", "4 More"), ("P", "It may end.")],
        ("pdf17", 1): [("H1", "1 Fonts"), ("P", "Old font.")], ("pdf17", 2): [("H1", "2 Gone"), ("P", "x")],
    }
    outline = [("v2", 1, None, 0, "1 Scope", 1), ("v2", 2, None, 1, "2 Fonts", 2), ("v2", 3, 2, 0, "2.1 Glyphs", 2), ("v2", 4, None, 2, "3 Terms", 3), ("v2", 5, None, 3, "4 More", 3), ("v2", 6, None, 4, "Lost", -1), ("pdf17", 1, None, 0, "1 Fonts", 1), ("pdf17", 2, None, 1, "2 Gone", 2)]
    nodes, items = [], []
    for (spec, number), blocks in pages.items():
        n, i = page(spec, number, blocks)
        nodes += n
        items += i
    make = lambda name, rows: spark.createDataFrame(rows, canonical.SCHEMAS[name])
    data = {
        "specs": make("specs", [(s, t, f, f, "standard", "", None, None) for s, t, f in SPECS]), "outline_entries": make("outline_entries", outline),
        "doc_stats": make("doc_stats", [("v2", 3), ("pdf17", 2)]), "struct_nodes": make("struct_nodes", nodes), "text_items": make("text_items", items),
    }
    folder = str(tmp_path_factory.mktemp("tables"))
    canonical.write(data, folder)
    e = Engine.open(spark, folder, default_spec="v2", new_spec="v2")
    yield e
    e.close()


def test_list_and_structure(engine):
    got = engine.list_specs()
    assert got["totalSpecs"] == 2 and {s["spec_id"]: (s["pages"], s["outline_entries"]) for s in got["specs"]} == {"v2": (3, 5), "pdf17": (2, 2)}
    assert engine.list_specs("nothing")["specs"] == []
    tree = engine.get_structure()
    assert (tree["totalPages"], tree["totalSections"]) == (3, 5)
    assert [t["title"] for t in tree["sections"]] == ["1 Scope", "2 Fonts", "3 Terms", "4 More", "Lost"] and tree["sections"][1]["children"][0]["sectionNumber"] == "2.1"
    assert engine.get_structure(max_depth=1)["sections"][1]["children"] == []


def test_section(engine):
    got = engine.get_section("2.1")
    assert got["pageRange"] == {"start": 2, "end": 2} and [c["text"] for c in got["content"]][:2] == ["2.1 Glyphs", "Glyph and font. A glyph should fit."]
    with pytest.raises(ContentError, match="Did you mean: 2"):
        engine.get_section("2.")
    with pytest.raises(ContentError, match="Use get_structure"):
        engine.get_section("99")
    with pytest.raises(RegistryError, match="not found"):
        engine.get_section("1", spec="nope")


def test_search(engine):
    got = engine.search_spec("FONT")
    assert [(r["section"], r["title"], r["page"], r["score"]) for r in got["results"]] == [("2.1", "Glyphs", 2, 12), ("1", "Scope", 1, 3)]
    assert engine.search_spec("font", max_results=1)["totalResults"] == 1 and engine.search_spec("absent")["results"] == []
    assert {r["spec_id"] for r in engine.search_all("font")["results"]} == {"v2", "pdf17"}


def test_requirements(engine):
    got = engine.get_requirements("2")
    assert [(r["id"], r["level"]) for r in got["requirements"]] == [("R-2.1-1", "should")]  # the parent's own text is not read
    full = engine.get_requirements()
    assert full["totalRequirements"] == sum(full["statistics"].values()) > 3 and full["filter"] == {"section": "all", "level": "all"}
    assert {r["level"] for r in engine.get_requirements(level="SHALL NOT")["requirements"]} == {"shall not"}
    with pytest.raises(ContentError, match="not found"):
        engine.get_requirements("77")


def test_definitions_and_tables(engine, monkeypatch):
    with pytest.raises(ContentError, match="only supported for"):
        engine.get_definitions()
    monkeypatch.setattr("folioflow.engine.DEFINED", ("v2",))
    assert engine.get_definitions()["definitions"] == [{"term": "glyph", "definition": "a drawn shape.", "section": "3.1"}]
    assert engine.get_definitions("DRAWN")["totalDefinitions"] == 1 and engine.get_definitions("zzz")["totalDefinitions"] == 0
    got = engine.get_tables("2.1")
    assert got["tables"] == [{"index": 0, "caption": "Table 1 - Kinds", "headers": ["Kind", "Use"], "rows": [["one", "two"]]}] == engine.get_tables("2.1", 0)["tables"]
    with pytest.raises(ContentError, match="out of range"):
        engine.get_tables("2.1", 1)


def test_compare(engine, monkeypatch):
    got = engine.compare_versions()
    assert got["matched"] == [{"oldSection": "1", "newSection": "2", "title": "Fonts", "status": "moved"}] and [r["section"] for r in got["removed"]] == ["2"] and got["totalAdded"] == 4
    assert engine.compare_versions("2")["totalAdded"] == 1
    monkeypatch.setattr(engine, "old", "nope")
    with pytest.raises(PrerequisiteError, match="requires"):
        engine.compare_versions()


def test_call_and_views(engine):
    assert json.loads(engine.call("nothing")) == {"error": "Unknown tool: nothing", "code": "INTERNAL_ERROR"}
    assert json.loads(engine.call("search_spec", {"query": " "}))["code"] == "VALIDATION_ERROR"
    assert json.loads(engine.call("get_structure", {"max_depth": 0}))["code"] == "VALIDATION_ERROR"
    assert json.loads(engine.call("get_section", {"section": "99"}))["code"] == "CONTENT_ERROR"
    assert json.loads(engine.call("list_specs"))["totalSpecs"] == 2
    engine.register_views()
    assert engine.spark.sql("SELECT count(*) FROM sections WHERE spec_id = 'v2'").first()[0] == 5


def test_registry(spark, tmp_path):
    for name in ("PDF32000_2008.pdf", "a-PDF32000_2008.pdf", "notes.txt", "other.pdf", "sub.pdf.bak"):
        (tmp_path / name).write_bytes(b"x")
    found = registry.classify(registry.list_files(spark, str(tmp_path)), registry.rules(spark)).collect()
    assert [(r.spec_id, r.filename, r.pages) for r in found] == [("pdf17", "PDF32000_2008.pdf", None)]


def test_other_sources(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("font\tfuente\nglyph\tglifo \"x\n")
    assert [tuple(r) for r in canonical.glossary(spark, str(tmp_path / "g.tsv")).collect()] == [("font", "fuente"), ("glyph", 'glifo "x')]
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "entries": [{"operation": "a", "durationMs": 5}]}))
    assert [tuple(r) for r in canonical.baseline(spark, str(tmp_path / "b.json")).collect()] == [("a", 5.0)]
    rows = spark.createDataFrame([("d", "x", "one"), ("d", "y", None)], "spec_id string, title string, dest string")
    dests = spark.createDataFrame([("d", "one", 4)], "spec_id string, dest string, page_index int")
    assert {(r.title, r.page) for r in canonical.resolve(rows, dests).collect()} == {("x", 5), ("y", -1)}
    pages = spark.createDataFrame([(1, "<h1>A <b>bold</h1><p>one<p>two<script>'</p>x'</script><ul><li>i</ul>")], "page_id long, html string")
    assert [(r.tag, r.text) for r in html.elements(pages).orderBy("elem_ord").collect()] == [("h1", "A bold"), ("p", "one"), ("p", "two"), ("li", "i")]
    # a header is no head, and a tag ends only at its own end
    pages = spark.createDataFrame([(1, "<head><title>t</title></head><header>x</header><p>keep one</p><nav>m</nav><p>keep two</p><script>a = '</nav>'; b('<p>no')</script><p>keep three</p>")], "page_id long, html string")
    assert [r.text for r in html.elements(pages).orderBy("elem_ord").collect()] == ["keep one", "keep two", "keep three"]
    timings = spark.createDataFrame([("b", 2.0), ("a", 1.5)], "name string, ms double")
    canonical.write_baseline(timings, f"{tmp_path}/times", "2")
    assert sorted(map(tuple, canonical.baseline(spark, f"{tmp_path}/times").collect())) == [("a", 1.5), ("b", 2.0)]


def test_a_document_reads_its_own_files(engine):
    engine.close()
    engine.search_spec("font")
    engine.get_section("2.1")
    assert {spec for _, spec in engine.held} == {"v2"}
    plan = engine._pages_of("v2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(spec_id,v2)" in plan
    engine.HELD = 1
    engine.search_spec("font", spec="pdf17")
    assert len(engine.held) == 2 and {spec for _, spec in engine.held} == {"pdf17"}
    del engine.HELD


def test_one_walk(engine, spark):
    def loops(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("UnionLoop ")

    secs = engine._sections_of("v2")
    assert loops(secs) == loops(outline.counts(secs)) == loops(outline.leaves(secs)) == loops(outline.section_keys(secs)) == 1
    assert loops(content.page_elements(engine._table("struct_nodes", None), engine._table("text_items", None))) == 1


def test_streaming_page_text(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for n in (1, 2):
        rows = [("d", n, 1, "text", None, "a", False), ("d", n, 2, "text", None, f"b{n}", False), ("d", n, 3, "end", None, None, None)]
        spark.createDataFrame(rows, canonical.SCHEMAS["text_items"]).coalesce(1).write.mode("append").parquet(source)
        append_page_text(spark, source, target, f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r.page, r.text) for r in spark.read.parquet(target).collect()) == [(1, "a b1"), (2, "a b2")]
    # a batch that is run again replaces what it wrote
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    append_page_text(spark, source, target, f"{tmp_path}/ck").awaitTermination(120)
    assert sorted((r.page, r.text) for r in spark.read.parquet(target).collect()) == [(1, "a b1"), (2, "a b2")]


def test_fixture_values_quote():
    assert fx.values("a, b", ("it's", None), (True, 1)) == "SELECT * FROM (VALUES ('it''s', NULL), (true, 1)) AS t(a, b)"


def test_sql_functions(engine, spark, tmp_path):
    """The operations as table functions say what the operations say, and read the folder of their document."""
    from folioflow.sources import published

    folder = str(tmp_path)
    published.publish(engine.data, folder, engine.old, engine.new)
    assert len(published.register(spark, folder, engine.default)) == 8

    def rows(call, order=None):
        found = spark.sql(f"SELECT * FROM {call}")
        return [r.asDict() for r in (found.orderBy(*order) if order else found).collect()]

    assert [r["spec_id"] for r in rows("list_specs()", ["filename"])] == [r["spec_id"] for r in engine.list_specs()["specs"]]
    assert [r["spec_id"] for r in rows("list_specs('nope')")] == [] and len(rows("list_specs('')")) == 2
    assert len(rows("get_structure(max_depth => 1)")) == len(engine.get_structure(max_depth=1)["sections"])
    for section in ("1", "2.1", "3"):
        want = engine.get_section(section)["content"]
        got = rows(f"get_section('{section}')", ["elem_ord"])
        assert [{k: r[k] for k in ("type", "level", "text", "label", "items", "headers", "rows") if r[k] is not None} for r in got] == want
        assert [{k: r[k] for k in ("index", "caption", "headers", "rows")} for r in rows(f"get_tables('{section}')", ["index"])] == engine.get_tables(section)["tables"]
    for query in ("font", "Font", "a font", "zz"):
        assert sorted(map(str, rows(f"search_spec('{query}')"))) == sorted(str({k: r[k] for k in ("section", "title", "page", "score", "snippet")}) for r in engine.search_spec(query)["results"])
    for arguments, options in (("", {}), ("level => 'shall'", {"level": "shall"}), ("section => '2'", {"section": "2"})):
        got = sorted((r["id"], r["level"], r["text"]) for r in rows(f"get_requirements({arguments})"))
        assert got == sorted((r["id"], r["level"], r["text"]) for r in engine.get_requirements(**options)["requirements"])
    got = rows("compare_versions()")
    want = engine.compare_versions()
    assert sum(r["kind"] == "matched" for r in got) == want["totalMatched"] and sum(r["kind"] == "added" for r in got) == want["totalAdded"]
    plan = spark.sql("SELECT * FROM search_spec('font', 'pdf17', 3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows("get_section('99')") == [] and rows("search_spec('font', 'nobody')") == []

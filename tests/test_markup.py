"""Web pages as canonical tables, against a machine with a stack that reads tags one by one."""

import html as entities
import random
import re

from pyspark.sql import functions as F

from folioflow.operators import content, outline
from folioflow.sources import canonical
from folioflow.sources import markup as mk


def machine(page):
    """(name, parent's place) of each node in order, and (text, parent's place) of each piece."""
    page = re.sub(mk.NO_TEXT, " ", page)
    made, texts, stack = [], [], []  # stack of (name, place)

    def say(text, inline=False):
        text = entities.unescape(re.sub("[ \t\n\f\r]+", " ", text)) if "&" in text else re.sub("[ \t\n\f\r]+", " ", text)
        if text.strip(" ") or (text and inline):
            texts.append((text, stack[-1][1] if stack else None))

    first, *rest = page.split("<")
    say(first)
    for cut in rest:
        if ">" not in cut:
            continue
        m = re.match("(/?)([A-Za-z][A-Za-z0-9]*)", cut)
        inside = cut[: cut.index(">")]
        if m:
            name, opens = m[2].lower(), not m[1] and not inside.endswith("/")
            if name in mk.BRACKETS:
                if opens:
                    while stack and mk.RANKS.get(stack[-1][0]) == 4:  # no text block holds a list or a table
                        stack.pop()
                    made.append((name, stack[-1][1] if stack else None))
                    stack.append((name, len(made) - 1))
                elif any(n == name for n, _ in stack):
                    while stack[-1][0] not in mk.BRACKETS:  # items, cells and blocks end with what holds them
                        stack.pop()
                    stack.pop()
            elif name in mk.RANKS:
                while stack and stack[-1][0] in mk.RANKS and mk.RANKS[stack[-1][0]] >= mk.RANKS[name]:
                    stack.pop()
                if opens:
                    made.append((name, stack[-1][1] if stack else None))
                    stack.append((name, len(made) - 1))
        say(cut[cut.index(">") + 1 :], not m or m[2].lower() not in {**mk.BRACKETS, **mk.RANKS})
    return made, texts


def tables(spark, pages):
    nodes, items = mk.canonical(spark.createDataFrame([("d", i, h) for i, h in enumerate(pages)], "spec_id string, page int, html string"))
    return nodes, items


def check(spark, pages):
    nodes, items = tables(spark, pages)
    said = {(r.page, r.content_id): r.text for r in content.marked_text(items).collect()}
    by_page = {}
    for r in nodes.orderBy("page", "node_id").collect():
        by_page.setdefault(r.page, []).append(r)
    for i, page in enumerate(pages):
        rows = by_page.get(i, [])
        assert [r.parent_id for r in rows if r.role == "Root"] == [None] * bool(rows) and all(r.parent_id for r in rows if r.role != "Root")
        order = {r.node_id: k for k, r in enumerate(r for r in rows if r.role and r.role != "Root")}
        got = ([(r.role, order.get(r.parent_id)) for r in rows if r.role and r.role != "Root"], [(said[i, r.content_id], order.get(r.parent_id)) for r in rows if not r.role])
        made, texts = machine(page) if page is not None else ([], [])
        if not rows:  # no tag, so no tree
            assert not made
            continue
        roles = {**mk.BRACKETS, **mk.ROLES}
        assert got == ([(roles[n], p) for n, p in made], texts), page


def test_random_pages(spark):
    rng = random.Random(1)
    names = [*"ul ol table div article p li tr td th h1 h2 pre thead tbody b i br".split()]

    def page():
        out = []
        for _ in range(rng.randint(1, 40)):
            k = rng.random()
            name = rng.choice(names)
            out.append(rng.choice(["some words", " ", "x &amp; y", "\n two\t", "a > b", "&#233;&#x1F600;&lt;", "&am", "& c"]) if k < 0.4 else f"<{name}>" if k < 0.75 else f"</{name}>" if k < 0.97 else f'<{name} class="a b"/>')
        return "".join(out) + rng.choice(["", "<", "<p cla"])

    check(spark, [page() for _ in range(150)])


def test_odd_pages(spark):
    check(spark, [None, "", "no tag at all", "<", "</div></ul>text", "<!-- <p>no</p> --><p>yes", "<head><title>t</title></head><P>A<P>B", "<ul><li>a<ul><li>b</ul>c<li>d</ul>e", "<p>" * 50, "<script>var a = '<p>';</script><pre>code</pre>", "<div>" * 40 + "deep", "<table><tr><td>1<td>2<tr><td>3</table>", "&bogus; &copy;&amp;lt;", "<p><b>a</b> <i>b</i>"])
    assert [(r.page, r.type, r.text) for r in content.page_elements(*tables(spark, [None, "", "no <tag", "none & at all"])).orderBy("page").collect()] == [(3, "paragraph", "none & at all")]
    nodes, items = tables(spark, ["&#0; &#xD800; &#1114112; &; &#x;"])  # no characters, so no entities
    assert [r.str for r in items.where("kind = 'text'").collect()] == ["&#0; &#xD800; &#1114112; &; &#x;"]


def test_elements_of_a_page(spark):
    page = "<html><body><nav><ul><li>menu</ul></nav><h2>1 Scope &amp; use</h2><p>NOTE 1 Some <b>bold</b> text<p>Second<ul><li>one<li>two <i>x</i></ul><table><thead><tr><th>a<th>b</thead><tbody><tr><td>1<td>2</table><pre>run()</pre>lost<footer><p>foot</footer>"
    got = content.page_elements(*tables(spark, [page])).orderBy("elem_ord").collect()
    assert [(r.type, r.level, r.text, r["items"], r.headers, r.rows) for r in got] == [
        ("heading", 2, "1 Scope & use", None, None, None), ("note", None, "Some bold text", None, None, None), ("paragraph", None, "Second", None, None, None),
        ("list", None, None, ["one", "two x"], None, None), ("table", None, None, None, ["a", "b"], [["1", "2"]]), ("code", None, "run()", None, None, None),
    ]


def test_outline_of_headings(spark, monkeypatch):
    monkeypatch.setattr(mk, "SPAN", 5)
    rng, rows, want = random.Random(2), [], []
    for spec in ("a", "b", None):
        before = []
        for n in range(60):
            level = rng.choice([1, 2, 2, 3, 3, 4, 6])
            rows.append((spec, n // 4, n % 4 + 1, level, f"h{n}"))
            parent = next((k for k in range(len(before), 0, -1) if before[k - 1] < level), None)
            before.append(level)
            want.append((spec, n + 1, parent, n + 1, f"h{n}", n // 4))
    rng.shuffle(rows)
    rows.append(("a", 3, 9, None, "no level"))
    got = mk.outline_entries(spark.createDataFrame(rows, "spec_id string, page int, elem_ord int, level int, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_documents_to_sections(spark, tmp_path):
    pages = [("d", 1, "<h1>1 A</h1><p>x<h2>1.1 B</h2>"), ("d", 3, "<h2>1.2 C</h2><p>y"), ("d", 4, "<h1>2 D</h1>"), ("e", 2, "<p>no heading")]
    made = mk.load(spark.createDataFrame(pages, "spec_id string, page int, html string"), str(tmp_path))
    secs = outline.sections(canonical.of_spec(made["outline_entries"], None), made["doc_stats"]).orderBy("spec_id", "ord")
    assert [(r.spec_id, r.section, r.title, r.page, r.end_page, r.depth, r.parent) for r in secs.collect()] == [("d", "1", "A", 1, 1, 0, None), ("d", "1.1", "B", 1, 2, 1, "1"), ("d", "1.2", "C", 3, 3, 1, "1"), ("d", "2", "D", 4, 4, 0, None)]
    assert made["doc_stats"].where(F.col("spec_id") == "e").first().total_pages == 2

"""Small tables written as SQL that both Spark and DuckDB read, for queries whose shapes the large tables do not have."""

from __future__ import annotations


def values(columns: str, *rows: tuple) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


FILES = values(
    "filename",
    ("ISO_32000-2_sponsored-ec2.pdf",), ("PDF32000_2008.pdf",), ("old-pdf32000_2008.PDF",), ("ISO_TS_32001-2022.pdf",), ("iso-ts-32004.pdf",), ("readme.txt",), ("unknown.pdf",), ("Tagged-PDF-Best-Practice.pdf",), ("PDF20_AN002-af.pdf",), ("PDF20_AN002-af.txt",), ("ISO-14289-2-2024.pdf",),
)

TITLES = values(
    "id, title",
    (1, "7 Syntax"), (2, "7.3.4 String objects"), (3, "1. Introduction"), (4, "4.1 artifact"), (5, "Annex A (normative) Rules"), (6, "Annex A.1 Scope"), (7, "appendix B: Notes"), (8, "Foreword"), (9, ""), (10, "7"), (11, "12.8.1  Two spaces"), (12, "ANNEX b (Informative)  More"), (13, "Annex about forms"), (14, "3. lower"),
)

MARKED = values(
    "spec_id, page, seq, kind, content_id, str, has_eol",
    ("d", 1, 1, "text", None, "outside", False), ("d", 1, 2, "begin_props", "a", None, None), ("d", 1, 3, "text", None, "one", True), ("d", 1, 4, "text", None, "two", False), ("d", 1, 5, "begin", None, None, None), ("d", 1, 6, "text", None, "!", False),
    ("d", 1, 7, "begin_props", "b", None, None), ("d", 1, 8, "text", None, "bee", False), ("d", 1, 9, "end", None, None, None), ("d", 1, 10, "text", None, "stray", False), ("d", 1, 11, "begin_props", "a", None, None), ("d", 1, 12, "end", None, None, None),
    ("d", 1, 13, "begin_props", "c", None, None), ("d", 1, 14, "text", None, "see", False), ("d", 1, 15, "begin_props", "c", None, None), ("d", 1, 16, "text", None, "sea", False), ("d", 2, 1, "text", None, "plain", True), ("d", 2, 2, "text", None, "page", False),
)

#: One page's roles: (node_id, parent_id, sib_ord, role, content_id).
_NODES = (
    (1, None, 0, "Sect", None), (2, 1, 0, "H1", None), (3, 2, 0, None, "h"), (4, 1, 1, "P", None), (5, 4, 0, None, "p1"), (6, 4, 1, "Span", None), (7, 6, 0, None, "p2"), (8, 4, 2, "Artifact", None), (9, 8, 0, None, "x"),
    (10, 1, 2, "Div", None), (11, 10, 0, "P", None), (12, 11, 0, None, "n"), (13, 1, 3, "L", None), (14, 13, 0, "LI", None), (15, 14, 0, "Lbl", None), (16, 15, 0, None, "x"), (17, 14, 1, "LBody", None), (18, 17, 0, None, "i1"),
    (19, 13, 1, "LI", None), (20, 19, 0, None, "i2"), (21, 13, 2, "LI", None), (22, 1, 4, "Table", None), (23, 22, 0, "THead", None), (24, 23, 0, "TR", None), (25, 24, 0, "TH", None), (26, 25, 0, None, "t1"), (27, 24, 1, "TH", None), (28, 27, 0, None, "t2"),
    (29, 22, 1, "TBody", None), (30, 29, 0, "TR", None), (31, 30, 0, "TH", None), (32, 31, 0, None, "t3"), (33, 30, 1, "TD", None), (34, 1, 5, "Table", None), (35, 34, 0, "TR", None), (36, 35, 0, "TH", None), (37, 36, 0, None, "t1"), (38, 34, 1, "TR", None), (39, 38, 0, "TD", None), (40, 39, 0, None, "t3"),
    (41, 1, 6, "H", None), (42, 41, 0, None, "h2"), (43, 1, 7, None, "x"), (44, 1, 8, "Code", None), (45, 44, 0, None, "c"), (46, 1, 9, "P", None), (47, 46, 0, None, "blank"), (48, 34, 2, "TR", None),
)
NODES = values("spec_id, page, node_id, parent_id, sib_ord, role, content_id", *(("d", 1, *n) for n in _NODES))
_PIECES = {"h": "7 Syntax", "p1": " First ", "p2": "part", "x": "never", "n": "NOTE 2 mind this", "i1": "item one", "i2": " item two ", "t1": "name", "t2": "use", "t3": "cell", "h2": "Bare", "c": "run()", "blank": "  "}
ITEMS = values(
    "spec_id, page, seq, kind, content_id, str, has_eol",
    *(row for i, (k, v) in enumerate(_PIECES.items()) for row in (("d", 1, 3 * i, "begin_props", k, None, None), ("d", 1, 3 * i + 1, "text", None, v, False), ("d", 1, 3 * i + 2, "end", None, None, None))),
    ("d", 2, 1, "text", None, "no tags", True), ("d", 2, 2, "text", None, "here ", False),
)
#: What the page above is read as: type, level, text, label, items, headers and rows with their parts joined.
ELEMENTS = values(
    "page, elem_ord, type, level, text, label, items, headers, cells",
    (1, 1, "heading", 1, "7 Syntax", None, None, None, None), (1, 2, "paragraph", None, "First part", None, None, None, None), (1, 3, "note", None, "mind this", "NOTE 2", None, None, None), (1, 4, "list", None, None, None, "item one|item two", None, None),
    (1, 5, "table", None, None, None, None, "name|use", "cell|"), (1, 6, "table", None, None, None, None, "name", "cell"), (1, 7, "heading", 3, "Bare", None, None, None, None), (1, 8, "code", None, "run()", None, None, None, None), (2, 1, "paragraph", None, "no tags\nhere", None, None, None, None),
)

SHALL = values(
    "spec_id, section, elem_ord, type, text",
    ("d", "7.1", 1, "paragraph", "A writer shall close files. A reader should not guess; it may ask. In 2020. Readers shall wait"), ("d", "7.1", 2, "note", "Shall we? It shall not. It shall not. See 3.14 and may."), ("d", "7.1", 3, "heading", "This shall not count"), ("d", "7.1", 4, "paragraph", "Marshall and mayhem do not count."), ("d", "7.2", 1, "paragraph", "Version 2.0 shall apply! Files SHOULD end."),
)

TERMS = values(
    "spec_id, elem_ord, type, text, label",
    ("d", 1, "heading", "3 Terms and definitions", None), ("d", 2, "paragraph", "For the purposes of this document, the following apply.", None), ("d", 3, "paragraph", "3.1", None), ("d", 4, "paragraph", "array", None), ("d", 5, "paragraph", "ordered run of objects.", None), ("d", 6, "note", "counted from 0", "NOTE 1"), ("d", 7, "paragraph", "[SOURCE: somewhere, 2.1]", None),
    ("d", 8, "heading", "3.7 byte", None), ("d", 9, "paragraph", "eight bits.", None), ("d", 10, "paragraph", "Always eight.", None), ("d", 11, "paragraph", "cell", None), ("d", 12, "paragraph", "place in a table.", None), ("d", 13, "heading", "4 Notation", None), ("d", 14, "paragraph", "late", None), ("d", 15, "paragraph", "not a definition.", None),
    ("e", 1, "paragraph", "Nothing is defined here.", None), ("f", 1, "paragraph", "dot", None), ("f", 2, "paragraph", "a mark.", None),
)
DEFINITIONS = values(
    "spec_id, number, term, definition, section, notes, source",
    ("d", 1, "array", "ordered run of objects. [SOURCE: somewhere, 2.1]", "3.1", "NOTE 1: counted from 0", "somewhere, 2.1"), ("d", 2, "byte", "eight bits. Always eight.", "3.2", None, None), ("d", 3, "cell", "place in a table.", "3.3", None, None), ("f", 1, "dot", "a mark.", "3.1", None, None),
)

#: Tables by header and row texts, cells joined by a bar and rows by a slash.
TABLES = values(
    "spec_id, section, elem_ord, type, text, headers, cells",
    ("d", "1", 1, "paragraph", "Table 1 - Keys", None, None), ("d", "1", 2, "table", None, "k|v", "a|b"), ("d", "1", 3, "paragraph", "between", None, None), ("d", "1", 4, "table", None, "k|v", "c|d/e|f"), ("d", "1", 5, "table", None, "x|y", "1|2"), ("d", "1", 6, "table", None, "", "q|r"), ("d", "1", 7, "table", None, "", "s|t"), ("d", "1", 8, "paragraph", "Table 2 of more", None, None), ("d", "1", 9, "table", None, "x|y", "3|4"),
    ("d", "2", 1, "paragraph", "Table 3 - Text", None, None), ("d", "2", 2, "paragraph", "Name  Use", None, None), ("d", "2", 3, "paragraph", "one  two  three", None, None), ("d", "2", 4, "paragraph", "stop here", None, None), ("d", "2", 5, "paragraph", "no  more", None, None), ("d", "2", 6, "paragraph", "Table 4 - None", None, None), ("d", "2", 7, "heading", "x  y", None, None), ("d", "2", 8, "paragraph", "Table 5 - Last", None, None), ("d", "2", 9, "paragraph", "h1  h2", None, None),
)
TABLES_READ = values(
    "section, \"index\", caption, headers, cells",
    ("1", 0, "Table 1 - Keys", "k|v", "a|b/c|d/e|f"), ("1", 1, None, "x|y", "1|2"), ("1", 2, None, "", "q|r"), ("1", 3, None, "", "s|t"), ("1", 4, "Table 2 of more", "x|y", "3|4"), ("2", 0, "Table 3 - Text", "Name|Use", "one|two|three"), ("2", 1, "Table 5 - Last", "h1|h2", ""),
)

TIMINGS = values("name, ms, base_ms", ("search", 58.0, 40.0), ("open", 3.0, 0.0), ("read", 100.0, 99.0), ("compare", 120.0, 100.0))

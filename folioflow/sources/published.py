"""What the operations answer from, as tables of a whole collection, and the operations as SQL table functions over them.

The tables are worked out once, for all documents, and dealt to folders by document like the canonical ones. Each function
filters by document and folder, so a call with constants reads the folder of its document alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import compare, content, definitions, outline, requirements, search, tables
from folioflow.sources import canonical, registry

#: Tables, and columns that they are sorted by in their files.
SORTED = {
    "tree": ["spec_id", "ord"], "sections": ["spec_id", "ord"], "section_keys": ["spec_id", "key"], "page_index": ["spec_id", "page"], "section_content": ["spec_id", "ord", "elem_ord"],
    "requirements": ["spec_id", "section", "number"], "definitions": ["spec_id", "number"], "section_tables": ["spec_id", "section", "index"],
}
NAMES = ("documents_found", *SORTED, "compared")


def publish(data: dict[str, DataFrame], folder: str, old_spec: str, new_spec: str, names: Iterable[str] = NAMES) -> None:
    """Writes the tables ``names`` of the canonical ``data`` (see canonical.SCHEMAS) to ``folder``; each reads those before it that it needs, so these are to be named or there.

    ``old_spec`` and ``new_spec`` are the two versions that are compared. Definitions are those of each document's section 3.
    """
    data = {name: canonical.of_spec(df, None) for name, df in data.items()}
    spark = next(iter(data.values())).sparkSession

    def told(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").drop("part") if name in SORTED else spark.read.parquet(f"{folder}/{name}")

    def built(name: str) -> DataFrame:
        if name == "tree":
            return outline.tree_rows(data["outline_entries"])
        if name == "sections":
            return outline.sections(data["outline_entries"], data["doc_stats"])
        if name == "section_keys":
            return outline.section_keys(told("sections"))
        if name == "page_index":
            pages = search.index(outline.page_sections(search.page_text(data["text_items"]), told("sections")))
            return search.with_titles(pages, told("sections"))
        if name == "section_content":
            return content.section_content(content.page_elements(data["struct_nodes"], data["text_items"]), told("sections"))
        if name == "requirements":
            return requirements.extract(told("section_content"))
        if name == "definitions":
            third = told("section_keys").where("key = '3'").select("spec_id", "ord")
            return definitions.extract(told("section_content").join(third, ["spec_id", "ord"], "left_semi"))
        if name == "section_tables":
            return tables.section_tables(told("section_content"))
        if name == "compared":
            return compare.compare(told("sections"), old_spec, new_spec)
        counts = outline.counts(told("sections")).select("spec_id", F.col("outline_entries").cast("int"))
        return registry.enrich(data["specs"], data["doc_stats"].withColumnRenamed("total_pages", "pages").join(counts, "spec_id", "left"))

    for name in sorted(names, key=lambda n: (n == "documents_found", NAMES.index(n))):
        df = built(name)
        if name in SORTED:
            dealt = df.withColumn("part", canonical.part_of(F.col("spec_id"))).repartition("part", F.pmod(F.xxhash64(SORTED[name][1]), F.lit(8)))
            dealt.sortWithinPartitions("part", *SORTED[name]).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"


def _own(function: str, table: str = "") -> str:
    """The condition that a row of a table is of the function's document, and in its folder."""
    at = f"{table}." if table else ""
    return f"{at}spec_id = {function}.spec AND {at}part = pmod(xxhash64({function}.spec), {canonical.PARTS})"


def _functions(default_spec: str) -> dict[str, tuple[str, str, str, str]]:
    """By name: the table that a function needs last, its arguments, its columns, and its query."""
    ws, spec = "[" + tx.WS[1:-1] + "]", f"spec STRING DEFAULT {_literal(default_spec)}"
    nq = f"regexp_replace(regexp_replace(lower(search_spec.query), {_literal(ws + '*-' + ws + '*')}, '-'), {_literal(ws + '+')}, ' ')"
    words = f"filter(split({nq}, ' '), w -> w <> '')"

    def times(word: str) -> str:
        return f"CAST((length(norm) - length(replace(norm, {word}, ''))) / length({word}) AS BIGINT)"

    held = f"contains(norm, {nq})"
    every = f"(size({words}) >= 2 AND forall({words}, w -> contains(norm, w)))"
    start = "CASE WHEN at <= 0 OR length(text) = 0 THEN 0 ELSE least(CAST(floor(at / length(norm) * length(text)) AS INT), length(text) - 1) END"
    a, b = "greatest(0, start - 75)", "least(length(text), start + length(search_spec.query) + 75)"
    trimmed = f"regexp_replace(substr(text, {a} + 1, {b} - {a}), {_literal('^' + ws + '+|' + ws + '+$')}, '')"

    def found_ord(f: str) -> str:
        """The place of the section that an argument names: as written, in lower case, or one letter as an annex."""
        key = f"{f}.section"
        annex = f"CASE WHEN {key} RLIKE '^[A-Za-z]$' THEN concat('Annex ', upper({key})) END"
        rank = f"CASE WHEN k.key = {key} THEN 1 WHEN k.key = lower({key}) THEN 2 ELSE 3 END"
        named = f"SELECT k.ord, {rank} AS rank FROM section_keys k WHERE {_own(f, 'k')} AND (k.key = {key} OR k.key = lower({key}) OR k.key = {annex})"
        return f"WITH named AS ({named}), chosen AS (SELECT min_by(ord, rank) AS ord FROM named)"

    def under(column: str, f: str) -> str:
        return f"({column} = {f}.section OR startswith({column}, concat({f}.section, '.')))"

    element = "elem_ord INT, type STRING, level INT, text STRING, label STRING, items ARRAY<STRING>, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>"
    return {
        "list_specs": ("documents_found", "category STRING DEFAULT NULL", "spec_id STRING, title STRING, filename STRING, category STRING, pages INT, outline_entries INT",
                       "SELECT d.spec_id, d.title, d.filename, d.category, d.pages, d.outline_entries FROM documents_found d WHERE coalesce(list_specs.category, '') = '' OR d.category = list_specs.category"),
        "get_structure": ("tree", f"{spec}, max_depth INT DEFAULT 64", "ord INT, section STRING, title STRING, page INT, depth INT",
                          f"SELECT ord, section, title, page, depth FROM tree WHERE {_own('get_structure')} AND depth < get_structure.max_depth"),
        "get_section": ("section_content", f"section STRING, {spec}", f"page INT, {element}",
                        f"{found_ord('get_section')} SELECT c.page, c.elem_ord, c.type, c.level, c.text, c.label, c.items, c.headers, c.rows FROM section_content c JOIN chosen ON c.ord = chosen.ord WHERE {_own('get_section', 'c')}"),
        "search_spec": ("page_index", f"query STRING, {spec}, max_results INT DEFAULT 10", "section STRING, title STRING, page INT, score BIGINT, snippet STRING", f"""
            WITH hit AS (SELECT section, title, page, text, norm, CASE WHEN {held} THEN 3 * {times(nq)} ELSE aggregate({words}, 0L, (s, w) -> s + {times('w')}) END AS score,
                CASE WHEN {held} THEN instr(norm, {nq}) - 1 ELSE array_min(transform({words}, w -> instr(norm, w) - 1)) END AS at
              FROM page_index WHERE {_own('search_spec')} AND ({held} OR {every})
            ), best AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(section, ''), concat('page:', page)) ORDER BY score DESC, page) AS n FROM hit
            ), ranked AS (SELECT *, {start} AS start, row_number() OVER (ORDER BY score DESC, page) AS r FROM best WHERE n = 1)
            SELECT section, title, page, score, concat(CASE WHEN {a} > 0 THEN '...' ELSE '' END, {trimmed}, CASE WHEN {b} < length(text) THEN '...' ELSE '' END) FROM ranked WHERE r <= search_spec.max_results"""),
        "get_requirements": ("requirements", f"section STRING DEFAULT NULL, level STRING DEFAULT NULL, {spec}", "id STRING, level STRING, text STRING, section STRING", f"""
            WITH chosen AS (SELECT s.section, s.parent FROM sections s WHERE {_own('get_requirements', 's')} AND {under('s.section', 'get_requirements')}
            ), leaf AS (SELECT DISTINCT c.section FROM chosen c LEFT ANTI JOIN chosen k ON k.parent = c.section)
            SELECT r.id, r.level, r.text, r.section FROM requirements r LEFT JOIN leaf ON leaf.section = r.section WHERE {_own('get_requirements', 'r')}
              AND (get_requirements.level IS NULL OR r.level = lower(trim(get_requirements.level))) AND (get_requirements.section IS NULL OR leaf.section IS NOT NULL)"""),
        "get_definitions": ("definitions", f"term STRING DEFAULT NULL, {spec}", "number INT, term STRING, definition STRING, section STRING, notes ARRAY<STRING>, source STRING",
                            f"SELECT d.number, d.term, d.definition, d.section, d.notes, d.source FROM definitions d WHERE {_own('get_definitions', 'd')} AND (get_definitions.term IS NULL OR contains(lower(d.term), lower(get_definitions.term)) OR contains(lower(d.definition), lower(get_definitions.term)))"),
        "get_tables": ("section_tables", f"section STRING, table_index INT DEFAULT NULL, {spec}", "index INT, caption STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>", f"""
            {found_ord('get_tables')} SELECT t.index, t.caption, t.headers, t.rows FROM section_tables t JOIN sections s ON s.section = t.section JOIN chosen ON s.ord = chosen.ord
            WHERE {_own('get_tables', 't')} AND {_own('get_tables', 's')} AND (get_tables.table_index IS NULL OR t.index = get_tables.table_index)"""),
        "compare_versions": ("compared", "section STRING DEFAULT NULL", "kind STRING, old_section STRING, new_section STRING, title STRING, status STRING",
                             f"SELECT c.kind, c.old_section, c.new_section, c.title, c.status FROM compared c WHERE compare_versions.section IS NULL OR coalesce({under('c.old_section', 'compare_versions')}, false) OR coalesce({under('c.new_section', 'compare_versions')}, false)"),
    }


def register(spark: SparkSession, folder: str, default_spec: str = registry.DEFAULT_SPEC, names: Iterable[str] = NAMES) -> list[str]:
    """Makes the tables ``names`` of ``folder`` views of the session, and functions of the operations that they suffice for: ``SELECT * FROM search_spec('font', 'pdf17', 5)``.

    Functions answer what Engine's operations of their names do, as rows; what these report as errors has no rows.
    """
    made, names = [], list(names)
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    needs = {"get_section": {"section_keys"}, "get_requirements": {"sections"}, "get_tables": {"section_keys", "sections"}}
    for name, (table, arguments, columns, query) in _functions(default_spec).items():
        if {table, *needs.get(name, ())} <= set(names):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {query}")
            made.append(name)
    return made

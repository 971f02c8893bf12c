"""The eight operations over one collection, with checked arguments and plain results."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import validation as check
from folioflow.functions.errors import ContentError, EngineError, PrerequisiteError, RegistryError, describe
from folioflow.functions.log import logger
from folioflow.operators import compare, content, definitions, outline, requirements, search, tables
from folioflow.sources import canonical, registry

# Documents whose terminology is section 3, and the two versions that are compared.
DEFINED = ("iso32000-2", "iso32000-2-2020", "pdf17")
OLD, NEW = "pdf17", registry.DEFAULT_SPEC


class Engine:
    """Operations over canonical tables (see sources.canonical). Results are dicts whose lists come from bounded queries of one document.

    The sections and the search index of a document are built from its own files when first asked for, and kept for the
    HELD documents that were asked for last.
    """

    HELD = 8

    def __init__(self, spark: SparkSession, data: dict[str, DataFrame], default_spec: str = registry.DEFAULT_SPEC, old_spec: str = OLD, new_spec: str = NEW) -> None:
        self.spark, self.data, self.default, self.old, self.new = spark, data, default_spec, old_spec, new_spec
        self.held: dict[tuple[str, str | None], DataFrame] = {}
        self.operations = {name: getattr(self, name) for name in ("list_specs", "get_structure", "get_section", "search_spec", "get_requirements", "get_definitions", "get_tables", "compare_versions")}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options: Any) -> Engine:
        return cls(spark, canonical.read(spark, folder), **options)

    def close(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

    def register_views(self) -> None:
        """The tables as views for SQL, with the sections and page texts of all documents; nothing is built before it is asked for."""
        whole = {"sections": self._sections_of(None), "page_text": self._pages_of(None)}
        for name, df in {**{name: canonical.of_spec(df, None) for name, df in self.data.items()}, **whole}.items():
            df.createOrReplaceTempView(name)

    def _table(self, name: str, spec: str | None) -> DataFrame:
        """A table, or a document's part of it."""
        return canonical.of_spec(self.data[name], spec)

    def _sections_of(self, spec: str | None) -> DataFrame:
        return outline.sections(self._table("outline_entries", spec), self._table("doc_stats", spec))

    def _pages_of(self, spec: str | None) -> DataFrame:
        return search.index(outline.page_sections(search.page_text(self._table("text_items", spec)), self.sections(spec) if spec else self._sections_of(None)))

    def _keep(self, what: str, spec: str | None, build: Callable[[str | None], DataFrame]) -> DataFrame:
        found = self.held.pop((what, spec), None)
        self.held[what, spec] = found if found is not None else build(spec).persist()
        while len(self.held) > 2 * self.HELD:
            self.held.pop(next(iter(self.held))).unpersist()
        return self.held[what, spec]

    def sections(self, spec: str) -> DataFrame:
        """The sections of a document."""
        return self._keep("sections", spec, self._sections_of)

    def pages(self, spec: str | None) -> DataFrame:
        """The search index of a document, or of all."""
        return self._keep("pages", spec, self._pages_of)

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> str:
        """An operation by name, as JSON; failures are {error, code}."""
        log = logger("engine")
        log.debug("%s %s", name, arguments or {})
        try:
            if name not in self.operations:
                raise EngineError(f"Unknown tool: {name}")
            out: Any = self.operations[name](**(arguments or {}))
        except (EngineError, TypeError) as e:
            out = describe(e)
            log.error("%s failed: %s (%s)", name, out["error"], out["code"])
        return json.dumps(out, ensure_ascii=False, indent=2)

    def _specs(self) -> DataFrame:
        keys = outline.counts(self._sections_of(None)).select("spec_id", F.col("outline_entries").cast("int"))
        return registry.enrich(self.data["specs"], self.data["doc_stats"].withColumnRenamed("total_pages", "pages").join(keys, "spec_id", "left"))

    def _spec(self, spec: Any) -> str:
        found = check.spec(spec)
        found = self.default if found is None else found
        if self.data["specs"].where(F.col("spec_id") == found).isEmpty():
            known = ", ".join(r.spec_id for r in self.data["specs"].select("spec_id").orderBy("spec_id").limit(100).collect())
            raise RegistryError(f'Specification "{found}" not found. Available specs: {known or "(none)"}')
        return found

    def _of(self, df: DataFrame, spec: str) -> DataFrame:
        return canonical.of_spec(df, spec)

    def _content(self, spec: str, secs: DataFrame) -> DataFrame:
        """Elements of some sections of a document; only pages that they cover are read."""
        first, last = secs.agg(F.min("page"), F.max(F.greatest("page", "end_page"))).first()
        pages = F.col("page").between(first if first is not None else 0, last if last is not None else -1)
        nodes, items = (self._of(self.data[t], spec).where(pages) for t in ("struct_nodes", "text_items"))
        return content.section_content(content.page_elements(nodes, items), secs)

    def _find(self, spec: str, section: str) -> Any:
        secs = self.sections(spec)
        asked = self.spark.createDataFrame([(spec, section)], "spec_id string, query string")
        row = outline.find_sections(secs, asked).first()
        if row is None or row.section is None:
            near = [r.section for r in outline.suggest(secs, section).orderBy("ord").collect()]
            hint = f"Did you mean: {', '.join(near)}?" if near else "Use get_structure to see available sections."
            raise ContentError(f'Section "{section}" not found. {hint}')
        return row

    def list_specs(self, category: str | None = None) -> dict:
        rows = [r.asDict() for r in registry.list_specs(self._specs(), category).orderBy("filename").collect()]
        return {"totalSpecs": len(rows), "specs": rows}

    def get_structure(self, spec: Any = None, max_depth: Any = None) -> dict:
        check.spec(spec)
        depth = check.max_depth(max_depth)
        spec = self._spec(spec)
        made: dict[int, dict] = {}
        top: list[dict] = []
        for r in outline.tree_rows(self._of(self.data["outline_entries"], spec), depth).orderBy("ord").collect():
            made[r.entry_id] = {"title": r.title, "page": r.page, "sectionNumber": r.section, "children": []}
            (top if r.parent_id is None else made[r.parent_id]["children"]).append(made[r.entry_id])
        info = self._of(self.data["specs"], spec).first()
        stats = self._of(self.data["doc_stats"], spec).first()
        return {"title": info.title, "totalPages": stats.total_pages if stats else None, "totalSections": self.sections(spec).count(), "sections": top}

    def get_section(self, section: Any, spec: Any = None) -> dict:
        check.spec(spec)
        section = check.section(section)
        spec = self._spec(spec)
        s = self._find(spec, section)
        rows = self._content(spec, self.sections(spec).where(F.col("ord") == s.ord)).orderBy("elem_ord").collect()
        keep = ("type", "level", "text", "label", "items", "headers", "rows")
        elements = [{k: r[k] for k in keep if r[k] is not None} for r in rows]
        return {"sectionNumber": s.section, "title": s.title, "pageRange": {"start": s.page, "end": s.end_page}, "content": elements}

    def search_spec(self, query: Any, spec: Any = None, max_results: Any = None) -> dict:
        check.spec(spec)
        query, most = check.query(query), check.max_results(max_results)
        spec = self._spec(spec)
        hits = search.with_titles(search.search(self.pages(spec), query, most), self.sections(spec))
        rows = [{k: r[k] for k in ("section", "title", "page", "snippet", "score")} for r in hits.orderBy(F.desc("score"), "page").collect()]
        return {"query": query, "totalResults": len(rows), "results": rows}

    def search_all(self, query: Any, max_results: Any = None) -> dict:
        """The search over all documents at once."""
        query, most = check.query(query), check.max_results(max_results)
        rows = [r.asDict() for r in search.search(self.pages(None), query, most, per_spec=False).collect()]
        return {"query": query, "totalResults": len(rows), "results": rows}

    def get_requirements(self, section: Any = None, level: Any = None, spec: Any = None) -> dict:
        check.spec(spec)
        section, level = check.optional_section(section), check.level(level)
        spec = self._spec(spec)
        secs = self.sections(spec)
        if section:
            secs = outline.subtree(secs, section)
            if secs.isEmpty():
                raise ContentError(f'Section "{section}" not found. Use get_structure to see available sections.')
            secs = outline.leaves(secs)
        found = requirements.extract(self._content(spec, secs))
        found = found.where(F.col("level") == level) if level else found
        titles = secs.groupBy("section").agg(F.max_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
        rows = [{k: r[k] for k in ("id", "level", "text", "section", "title")} for r in found.join(titles, "section").orderBy("ord", "number").collect()]
        levels: dict[str, int] = {}
        for r in rows:
            levels[r["level"]] = levels.get(r["level"], 0) + 1
        return {"filter": {"section": section or "all", "level": level or "all"}, "totalRequirements": len(rows), "statistics": levels, "requirements": rows}

    def get_definitions(self, term: Any = None, spec: Any = None) -> dict:
        check.spec(spec)
        term = check.term(term)
        spec = self._spec(spec)
        if spec not in DEFINED:
            raise ContentError(f'get_definitions is only supported for {", ".join(DEFINED)}. For "{spec}", use get_section with section "3" instead.')
        s = self._find(spec, "3")
        elements = self._content(spec, self.sections(spec).where(F.col("ord") == s.ord)).persist()  # read more than once
        found = definitions.matching(definitions.extract(elements), term)
        rows = [{k: v for k, v in r.asDict().items() if k not in ("spec_id", "number") and v is not None} for r in found.orderBy("number").collect()]
        elements.unpersist()
        return {"totalDefinitions": len(rows), "searchTerm": term, "definitions": rows}

    def get_tables(self, section: Any, table_index: Any = None, spec: Any = None) -> dict:
        check.spec(spec)
        section, index = check.section(section), check.table_index(table_index)
        spec = self._spec(spec)
        s = self._find(spec, section)
        elements = self._content(spec, self.sections(spec).where(F.col("ord") == s.ord)).persist()  # read more than once
        rows = [{k: r[k] for k in ("index", "caption", "headers", "rows")} for r in tables.section_tables(elements).orderBy("index").collect()]
        elements.unpersist()
        if index is not None:
            if index >= len(rows):
                raise ContentError(f'Table index {index} out of range: section "{s.section}" has {len(rows)} table(s)')
            rows = rows[index : index + 1]
        return {"sectionNumber": s.section, "title": s.title, "totalTables": len(rows), "tables": rows}

    def compare_versions(self, section: Any = None) -> dict:
        known = {r.spec_id for r in self.data["specs"].where(F.col("spec_id").isin(self.old, self.new)).select("spec_id").collect()}
        for spec in (self.old, self.new):
            if spec not in known:
                raise PrerequisiteError(f'compare_versions requires "{spec}"')
        section = check.optional_section(section)
        rows = compare.compare(self.sections(self.old).unionByName(self.sections(self.new)) if self.old != self.new else self.sections(self.old), self.old, self.new)
        rows = compare.within(rows, section) if section else rows
        out: dict[str, list] = {"matched": [], "added": [], "removed": []}
        for r in rows.orderBy("ord").collect():
            if r.kind == "matched":
                out[r.kind].append({"oldSection": r.old_section, "newSection": r.new_section, "title": r.title, "status": r.status})
            else:
                out[r.kind].append({"section": r.new_section or r.old_section, "title": r.title})
        return {"totalMatched": len(out["matched"]), "totalAdded": len(out["added"]), "totalRemoved": len(out["removed"]), **out}

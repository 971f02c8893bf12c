"""Finding documents among files: the first rule whose pattern a file name matches tells what it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioflow.functions.errors import RegistryError

DEFAULT_SPEC = "iso32000-2"

# The rules in their order (pattern, id, category, title, description).
RULES = (
    (r"ISO_32000-2_sponsored-ec2\.pdf$", "iso32000-2", "standard", "ISO 32000-2:2020 (PDF 2.0) with Errata Collection 2", "The current PDF 2.0 specification with errata corrections"),
    (r"ISO_32000-2-2020_sponsored\.pdf$", "iso32000-2-2020", "standard", "ISO 32000-2:2020 (PDF 2.0) original", "Original PDF 2.0 specification without errata"),
    (r"PDF32000_2008\.pdf$", "pdf17", "standard", "ISO 32000-1:2008 (PDF 1.7)", "The PDF 1.7 specification (first ISO-standardized version)"),
    (r"pdfreference1\.7old\.pdf$", "pdf17old", "standard", "PDF Reference 1.7 (Adobe)", "Adobe PDF Reference, version 1.7 (pre-ISO)"),
    (r"ISO_TS_32001.*\.pdf$", "ts32001", "ts", "ISO/TS 32001:2022", "Extensions to Hash Algorithms in ISO 32000-2 (SHA-3)"),
    (r"ISO_TS_32002.*\.pdf$", "ts32002", "ts", "ISO/TS 32002:2022", "Extensions to Digital Signatures in ISO 32000-2 (ECC/PAdES)"),
    (r"ISO_TS_32003.*\.pdf$", "ts32003", "ts", "ISO/TS 32003:2023", "Adding support of AES-GCM in PDF 2.0"),
    (r"ISO[-_]TS[-_]32004.*\.pdf$", "ts32004", "ts", "ISO/TS 32004:2024", "Integrity protection in encrypted documents in PDF 2.0"),
    (r"ISO[-_]TS[-_]32005.*\.pdf$", "ts32005", "ts", "ISO/TS 32005:2023", "PDF 1.7 and 2.0 structure namespace mapping"),
    (r"ISO[-_]14289[-_]1.*\.pdf$", "pdfua1", "pdfua", "ISO 14289-1:2014 (PDF/UA-1)", "PDF/UA-1: Accessibility using ISO 32000-1"),
    (r"ISO[-_]14289[-_]2.*\.pdf$", "pdfua2", "pdfua", "ISO 14289-2:2024 (PDF/UA-2)", "PDF/UA-2: Accessibility using ISO 32000-2"),
    (r"Tagged-PDF-Best-Practice", "tagged-bpg", "guide", "Tagged PDF Best Practice Guide: Syntax 1.0.1", "PDF Association guide for tagged PDF syntax"),
    (r"Well-Tagged-PDF-WTPDF", "wtpdf", "guide", "Well-Tagged PDF (WTPDF) 1.0", "Using Tagged PDF for Accessibility and Reuse in PDF 2.0"),
    (r"PDF-Declarations\.pdf$", "declarations", "guide", "PDF Declarations", "PDF Association specification for PDF Declarations"),
    (r"PDF20_AN001", "an001", "appnote", "PDF 2.0 Application Note 001", "Black Point Compensation"),
    (r"PDF20_AN002", "an002", "appnote", "PDF 2.0 Application Note 002", "Associated Files"),
    (r"PDF20_AN003", "an003", "appnote", "PDF 2.0 Application Note 003", "Object Metadata Locations"),
)


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table (ord, pattern, spec_id, category, title, description)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "ord int, pattern string, spec_id string, category string, title string, description string")


def list_files(spark: SparkSession, folder: str | None) -> DataFrame:
    """The files of a folder (path, filename, length, modified), not of those below it; contents are not read.

    A folder that is not set, or cannot be read, is an error that names it.
    """
    if not folder:
        raise RegistryError("No folder of documents is set")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    except AnalysisException as e:
        raise RegistryError(f"Cannot read the folder of documents {folder}: {e.getCondition() or e}") from e
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("modificationTime").alias("modified"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """What became of files between two listings (path, length, modified): path, change (new, changed, gone); files that stayed are left out."""
    b, n = before.select("path", "length", "modified").alias("b"), now.select("path", "length", "modified").alias("n")
    both = b.join(n, F.col("b.path") == F.col("n.path"), "full")
    same = F.col("b.length").eqNullSafe(F.col("n.length")) & F.col("b.modified").eqNullSafe(F.col("n.modified"))
    change = F.when(F.col("b.path").isNull(), "new").when(F.col("n.path").isNull(), "gone").when(~same, "changed")
    return both.select(F.coalesce("n.path", "b.path").alias("path"), change.alias("change")).where("change IS NOT NULL")


def refresh(specs: DataFrame, now: DataFrame, changed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The registry of the files ``now``, with what ``specs``, the registry before, knows of documents whose file stayed as it was.

    Documents whose file is new or ``changed``, or that another file stands for now, are without figures until they are read.
    """
    kept = specs.join(changed.select("path"), "path", "left_anti").select("spec_id", "path", F.col("pages").alias("old_pages"), F.col("outline_entries").alias("old_entries"))
    found = classify(now, known).drop("pages", "outline_entries").join(kept, ["spec_id", "path"], "left")
    return found.select(*[F.col("old_pages").alias(c) if c == "pages" else F.col("old_entries").alias(c) if c == "outline_entries" else F.col(c) for c in specs.columns])


def classify(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The registry: one row per document found among ``files`` (filename, and path where there is one).

    Only ``*.pdf`` counts, in any case. A file is what the first of the rules that its name matches says; of files of one
    document the first by name stays. Other files are left out. The rules are those of this module, each a constant pattern that
    is compiled once, or a table like :func:`rules` in ``known``.
    """
    if "path" not in files.columns:
        files = files.withColumn("path", F.col("filename"))
    pdf = files.where(F.endswith(F.lower("filename"), F.lit(".pdf"))).select("filename", "path")
    facts = ("spec_id", "category", "title", "description")
    if known is None:
        rule = F.coalesce(*[F.when(F.rlike("filename", F.lit(f"(?i){pattern}")), F.struct(*[F.lit(x).alias(c) for c, x in zip(facts, said)])) for pattern, *said in RULES])
        by_rule = pdf.withColumn("rule", rule).where("rule IS NOT NULL").select("filename", "path", "rule.*")
    else:
        matched = pdf.join(F.broadcast(known), F.rlike(F.col("filename"), F.concat(F.lit("(?i)"), F.col("pattern"))))
        by_rule = matched.withColumn("n", F.row_number().over(Window.partitionBy("path", "filename").orderBy("ord"))).where("n = 1")
    best = by_rule.groupBy("spec_id").agg(F.min(F.struct("filename", "path", *facts[1:])).alias("f"))
    empty = F.lit(None).cast("int")
    return best.select("spec_id", "f.title", "f.filename", "f.path", "f.category", "f.description", empty.alias("pages"), empty.alias("outline_entries"))


def enrich(specs: DataFrame, stats: DataFrame) -> DataFrame:
    """``specs`` with pages and outline_entries filled from ``stats`` (spec_id, pages, outline_entries) where they are null."""
    s = stats.select("spec_id", F.col("pages").alias("new_pages"), F.col("outline_entries").alias("new_entries"))
    out = specs.join(s, "spec_id", "left").withColumns({"pages": F.coalesce("pages", "new_pages"), "outline_entries": F.coalesce("outline_entries", "new_entries")})
    return out.select(*specs.columns)


def list_specs(specs: DataFrame, category: str | None = None) -> DataFrame:
    """All documents, or those of a category; an unknown category has none, an empty one is no filter."""
    return specs.where(F.col("category") == category) if category else specs

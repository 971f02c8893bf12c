"""The tables that the operators work on, and how they are kept as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "specs": "spec_id string, title string, filename string, path string, category string, description string, pages int, outline_entries int",
    "outline_entries": "spec_id string, entry_id bigint, parent_id bigint, sib_ord int, title string, page int",
    "doc_stats": "spec_id string, total_pages int",
    "struct_nodes": "spec_id string, page int, node_id bigint, parent_id bigint, sib_ord int, role string, content_id string",
    "text_items": "spec_id string, page int, seq int, kind string, content_id string, str string, has_eol boolean",
}
#: What is read page by page is dealt by document to so many folders, however many documents there are, and sorted in files: a query of one document reads a folder, and of its files the row groups that may hold the document.
BY_SPEC, PARTS = {"struct_nodes", "text_items", "outline_entries"}, 256
#: Pages of a document that are written together.
PAGES = 4096


def part_of(spec_id: Column) -> Column:
    return F.pmod(F.xxhash64(spec_id), F.lit(PARTS)).cast("int")


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables to a folder of their own each; what was there is replaced."""
    for name, df in tables.items():
        if name in BY_SPEC:
            dealt = df.withColumn("part", part_of(F.col("spec_id")))
            dealt = dealt.repartition("part", F.floor(F.col("page") / PAGES)).sortWithinPartitions("part", "spec_id", "page")
            dealt.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")
        else:
            df.sortWithinPartitions("spec_id").write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """All or some tables as :func:`write` lays them out; those that are dealt have a column ``part``, which :func:`of_spec` uses and drops."""
    return {name: spark.read.schema(schema + (", part int" if name in BY_SPEC else "")).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items() if name in names}


def of_spec(table: DataFrame, spec: str | None) -> DataFrame:
    """A document's rows of a table, or all."""
    own = table if spec is None else table.where(F.col("spec_id") == spec)
    if "part" not in table.columns:
        return own
    return (own if spec is None else own.where(F.col("part") == part_of(F.lit(spec)))).drop("part")


def resolve(outline: DataFrame, dests: DataFrame) -> DataFrame:
    """Outline rows with a destination name (column dest) given the page that ``dests`` (spec_id, dest, page_index from 0) says, -1 where it says none."""
    joined = outline.join(dests, ["spec_id", "dest"], "left")
    return joined.withColumn("page", F.coalesce(F.col("page_index") + 1, F.lit(-1)).cast("int")).drop("dest", "page_index")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """A headerless two-column glossary (term, translation), tab-separated."""
    return spark.read.csv(path, sep="\t", schema="term string, translation string", quote="")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Recorded timings (name, ms) of a JSON file {version, entries: [{operation, durationMs}]}."""
    raw = spark.read.schema("version string, entries array<struct<operation:string,durationMs:double>>").option("multiLine", "true").json(path)
    return raw.select(F.explode("entries").alias("e")).select(F.col("e.operation").alias("name"), F.col("e.durationMs").alias("ms"))


def write_baseline(timings: DataFrame, path: str, version: str) -> None:
    """Writes timings (name, ms) as one JSON file in the folder ``path``, of the form that :func:`baseline` reads; in order of their names."""
    entry = F.struct(F.col("name").alias("operation"), F.col("ms").cast("double").alias("durationMs"))
    whole = timings.agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(F.lit(version).alias("version"), "entries")
    whole.coalesce(1).write.mode("overwrite").json(path)

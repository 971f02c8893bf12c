"""A substring index: which pages hold each three letters, so that a search reads few texts.

An index is a folder with two tables. ``texts`` has the pages as searches read them; ``postings`` has, for each gram (three
characters of the normalised text, or what is left at its end) and span of SPAN pages, the places of the pages that hold it, as
differences. Postings are dealt to files by the gram's first two characters, so that a search reads those of its own grams, and
texts lie in a folder per span, sorted by place. New pages are appended as a batch of their own; batches are merged into one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import search as pages_search
from folioflow.sources import shared

#: Pages of a span, and of texts that are cut into grams at a time.
SPAN, ROWS = 1 << 16, 1024
#: Files that postings are dealt to.
BUCKETS = 64
#: Of a query's grams so many of the rarest are looked up; the texts themselves decide.
RAREST = 6
#: Pages found are looked up by their places in the query up to this many, and joined beyond.
LOOKUPS = 2000
TEXTS = "span string, place int, spec_id string, page bigint, section string, text string, norm string"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (span, place, norm) the places by gram and span, some rows at a time: every place of a text begins a gram, at the end a shorter one."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch, found = whole.slice(start, ROWS), {}
            for span, place, norm in zip(*[batch.column(c).to_pylist() for c in ("span", "place", "norm")]):
                places = found.setdefault(span, defaultdict(list))
                for gram in {norm[i : i + 3] for i in range(len(norm))}:
                    places[gram].append(place)
            for span, places in found.items():
                columns = [pa.array(list(places)), pa.array([span] * len(places)), pa.array(list(places.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "span", "places"])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(F.substring(gram, 1, 2)), F.lit(BUCKETS)).cast("int")


def add(pages: DataFrame, folder: str, batch: str) -> None:
    """Writes ``pages`` (spec_id, page, section, text) into the index as ``batch``; one that is written again replaces what it wrote.

    Pages without text are in the index too, and found by nothing. Pages are taken to be new: see :func:`merge` for repeated ones.
    """
    spark = pages.sparkSession
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    placed = pages.select("spec_id", F.col("page").cast("bigint").alias("page"), "section", "text").withColumn("at", F.struct(part.alias("part"), row.alias("row")))
    span = F.concat_ws("-", F.lit(batch), F.col("at.part").cast("string"), F.floor(F.col("at.row") / SPAN).cast("string"))
    texts = placed.select(span.alias("span"), (F.col("at.row") % SPAN).cast("int").alias("place"), "spec_id", "page", "section", "text", tx.norm_search(F.coalesce("text", F.lit(""))).alias("norm"))
    texts.write.mode("overwrite").partitionBy("span").parquet(f"{folder}/texts/{batch}")
    written = spark.read.schema(TEXTS).parquet(f"{folder}/texts/{batch}").select("span", "place", "norm").where("norm <> ''")
    each = written.mapInArrow(_lists, "gram string, span string, places array<int>")
    lists = each.groupBy("gram", "span").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    steps = F.transform("places", lambda p, i: F.when(i == 0, p).otherwise(p - F.get("places", i - 1)))
    postings = lists.select("gram", "span", F.size("places").alias("n"), steps.alias("steps"), _bucket(F.col("gram")).alias("bucket"))
    postings.repartition("bucket", F.pmod(F.xxhash64("span"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/{batch}")


def batches(spark: SparkSession, folder: str) -> list[str]:
    return shared.folders(spark, f"{folder}/texts")


def texts(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """The pages of some batches, or all."""
    found = [spark.read.schema(TEXTS).parquet(f"{folder}/texts/{b}") for b in (batches(spark, folder) if names is None else names)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], TEXTS)


def postings(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    """Lists of the grams that are, or begin with, one of ``wanted`` (those of two characters): asked, gram, span, n, steps. Only their files are read."""
    schema = "gram string, span string, n int, steps array<int>, bucket int"
    whole, begin = [w for w in wanted if len(w) == 3], [w for w in wanted if len(w) == 2]
    held = F.col("gram").isin(whole)
    for w in begin:
        held |= F.startswith("gram", F.lit(w))
    own = spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w")).alias("b")).distinct().collect()
    found = [spark.read.schema(schema).parquet(f"{folder}/postings/{b}") for b in batches(spark, folder)]
    rows = reduce(DataFrame.unionByName, found).where(F.col("bucket").isin([r.b for r in own]) & held)
    asked = F.when(F.col("gram").isin(whole), F.array("gram")).otherwise(F.array()).cast("array<string>")
    asked = F.concat(asked, F.filter(F.array(*map(F.lit, begin)).cast("array<string>"), lambda w: F.startswith("gram", w)))
    return rows.select(F.explode(asked).alias("asked"), "gram", "span", "n", "steps")


def query_grams(query: str) -> list[str]:
    """Grams that a page hit by the query must hold; parts of two characters where a word has no more, none for single characters."""
    phrase = tx.norm_query(query)
    words = [w for w in re.split(tx.WS + "+", phrase) if w]
    needed = words if len(words) >= 2 else [phrase]  # who holds the phrase holds its words
    return sorted({w[i : i + 3] for w in needed if len(w) >= 2 for i in range(max(1, len(w) - 2))})


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """Places (span, place) of the pages that hold the rarest grams of the query; None where it has none, and all pages are to be read."""
    wanted = query_grams(query)
    if not wanted or not batches(spark, folder):
        return None
    lists = postings(spark, folder, wanted)
    sizes = {r.asked: r.n for r in lists.groupBy("asked").agg(F.sum("n").alias("n")).collect()}  # one row per gram of the query
    if len(sizes) < len(wanted):
        return spark.createDataFrame([], "span string, place int")
    rarest = sorted(wanted, key=lambda w: (sizes[w], w))[:RAREST]
    each = lists.where(F.col("asked").isin(rarest)).select("asked", "gram", "span", F.posexplode("steps").alias("i", "step"))
    place = F.sum("step").over(Window.partitionBy("asked", "gram", "span").orderBy("i")).cast("int")
    found = each.select("asked", "span", place.alias("place")).groupBy("span", "place").agg(F.count_distinct("asked").alias("k"))
    return found.where(F.col("k") == len(rarest)).select("span", "place")


def search(spark: SparkSession, folder: str, query: str, max_results: int | None = 10, per_spec: bool = True) -> DataFrame:
    """The same as :func:`search.search` over all pages of the index, which reads the texts of candidates alone."""
    every = texts(spark, folder)
    found = candidates(spark, folder, query)
    if found is not None:
        few = found.limit(LOOKUPS + 1).collect()
        if len(few) <= LOOKUPS:  # spans are folders and places are sorted in files: what is not asked for is not read
            by_span: dict[str, list[int]] = {}
            for r in few:
                by_span.setdefault(r.span, []).append(r.place)
            here = F.lit(False)
            for span, places in sorted(by_span.items()):
                here |= (F.col("span") == span) & F.col("place").isin(sorted(places))
            every = every.where(here)
        else:
            every = every.join(found, ["span", "place"], "left_semi")
    return pages_search.search(every, query, max_results, per_spec)


def merge(spark: SparkSession, folder: str, into: str, names: list[str] | None = None) -> None:
    """Makes one batch of several, or of all, and deletes those. Of a page that several have, that of the last batch by name stays."""
    old = batches(spark, folder) if names is None else sorted(names)
    if into in old:
        raise ValueError(f"batch {into} is one of those that are merged")
    rows = [texts(spark, folder, [b]).select("spec_id", "page", F.struct(F.lit(i).alias("batch"), "section", "text").alias("p")) for i, b in enumerate(old)]
    if not rows:
        return
    last = reduce(DataFrame.unionByName, rows).groupBy("spec_id", "page").agg(F.max_by("p", "p.batch").alias("p"))
    add(last.select("spec_id", "page", "p.section", "p.text"), folder, into)
    for b in old:
        shared.delete(spark, f"{folder}/texts/{b}")
        shared.delete(spark, f"{folder}/postings/{b}")

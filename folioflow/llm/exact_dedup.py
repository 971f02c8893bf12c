"""Exact deduplication through an extendible-hash index on shared files, with DataFrame operations only.

A directory maps the leading bits of a text's hash to buckets, ranges of keys of at most so many each; it doubles for as long
as a bucket is overfull. Rows are dealt to buckets by the directory. In a bucket, rows of equal hash are compared by their
bytes, and the task that owns the bucket chains the texts that differ. The index is a table in the shared folder, which rows
probe: slot, bucket, hash, link of the chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, id_key, materialize, read

#: Keys that a bucket holds before it splits, and the deepest directory: 2**MAX_DEPTH slots, a small table at any number of rows.
CAPACITY, MAX_DEPTH = 2_000, 20


def slot(depth: int, key: str = "h") -> Column:
    """Where a key falls in a directory of ``depth`` bits: its leading bits, so a slot is a range of keys."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(F.col(key), 64 - depth)


def buckets_of(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets (depth, slot, n) such that none holds over ``capacity`` of the different ``keys`` (column h), but for those at max_depth.

    The directory starts at the depth that so many keys would need if they were even, and doubles for as long as a bucket is
    overfull; only overfull buckets are counted again, a bit deeper. What is counted is one row per slot, never keys.
    """
    counts = materialize(keys.groupBy(slot(max_depth).alias("s")).count(), "index-counts")
    n_keys = counts.agg(F.sum("count")).first()[0] or 0
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1, n_keys / capacity)))))
    at = counts.groupBy(F.shiftright("s", max_depth - depth).alias("slot")).agg(F.sum("count").alias("n"))
    buckets = None
    while True:
        at = materialize(at, "index-level")
        full = F.col("n") > capacity if depth < max_depth else F.lit(False)
        kept = at.where(~full).select(F.lit(depth).alias("depth"), "slot", "n")
        buckets = kept if buckets is None else buckets.unionByName(kept)
        if depth == max_depth or at.where(full).isEmpty():
            return buckets
        over, depth = at.where(full).select("slot"), depth + 1
        deeper = counts.select(F.shiftright("s", max_depth - depth).alias("slot"), "count", F.shiftright("s", max_depth - depth + 1).alias("parent"))
        at = deeper.join(over.withColumnRenamed("slot", "parent"), "parent", "left_semi").groupBy("slot").agg(F.sum("count").alias("n"))


@dataclass
class Directory:
    """``slots`` (slot, bucket) of a directory of ``depth`` bits; several slots may name one bucket, that of the first of them."""

    depth: int
    slots: DataFrame

    @staticmethod
    def of(buckets: DataFrame) -> Directory:
        depth = buckets.agg(F.max("depth")).first()[0] or 0
        first = F.expr(f"shiftleft(slot, {depth} - depth)")
        slots = buckets.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("slot"), first.alias("bucket"))
        return Directory(depth, materialize(slots, "index-directory"))

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` (column h, ...) with their bucket."""
        return rows.withColumn("slot", slot(self.depth)).join(F.broadcast(self.slots), "slot").drop("slot")


@dataclass
class Index:
    """A directory and the table of its buckets: bucket, h, chain (an array of text_sha256, keep_id, group_size)."""

    directory: Directory
    chains: DataFrame


Key = Callable[[Column], Column]


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key: Key = F.xxhash64) -> Index:
    """The index of ``docs``' texts, on shared files.

    Rows go to the bucket that the directory names for their hash. Within it texts of equal hash are grouped by their bytes;
    copies are pre-aggregated before the shuffle, so a group of copies of any size arrives as a row per task. The owner of a
    bucket then sees one entry per different text and chains those of a hash. A chain is as long as texts collide.
    """
    hashed = docs.select("doc_id", empty_if_null("text").alias("text")).withColumn("h", key(F.col("text")))
    directory = Directory.of(buckets_of(hashed.select("h").distinct(), capacity, max_depth))
    entries = directory.deal(hashed).groupBy("bucket", "h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = entries.select("bucket", "h", F.struct(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size").alias("link")).repartition("bucket")
    chains = owned.groupBy("bucket", "h").agg(F.array_sort(F.collect_list("link")).alias("chain"))
    return Index(directory, materialize(chains, "index"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key: Key = F.xxhash64) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; others are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text equals the empty one. The largest doc_id of equal texts stays (a null
    doc_id stays only where all are null). Rows that agree in doc_id and text are copies of which each is marked ``kept`` if
    their doc_id is; :func:`drop_copies` leaves one. A row probes its bucket for its hash and takes the link of the chain
    that has its digest; Spark splits the hot hashes. ``key`` is the hash, from a text to a bigint.
    """
    index = build_index(docs, capacity, max_depth, key)
    text = empty_if_null("text")
    rows = index.directory.deal(docs.select("doc_id", key(text).alias("h"), F.sha2(text, 256).alias("text_sha256")))
    found = rows.join(index.chains, ["bucket", "h"])
    link = F.get(F.filter("chain", lambda x: x.text_sha256 == F.col("text_sha256")), F.lit(0))
    found = found.select("doc_id", link.keep_id.alias("keep_id"), link.group_size.alias("group_size"), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``docs`` with all its columns, one row for each text: that of the largest doc_id.

    Where several rows agree in both doc_id and text, any one of them stays.
    """
    index = build_index(docs, capacity, max_depth)
    keep = index.chains.select("bucket", "h", F.explode("chain").alias("x")).select("bucket", "h", "x.text_sha256", id_key("x.keep_id").alias("id_key"))
    keys = ["bucket", "h", "text_sha256", "id_key"]  # with the id among them, copies of one text are dealt to many tasks
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.xxhash64(empty_if_null("text")).alias("h"), F.sha2(empty_if_null("text"), 256).alias("text_sha256"), id_key().alias("id_key"), whole)
    return index.directory.deal(rows).join(keep, keys).groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

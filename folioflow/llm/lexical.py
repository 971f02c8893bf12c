"""Ranked lexical search by three-phase uniform thresholds over postings that are partitioned by term.

For each query: the heads of its terms' lists, the best few documents of each, give a lower bound of the score that a result
has; divided by the number of lists it is a threshold that a result reaches in one list at least. What is above the threshold
in any list gives a better bound, and the documents that may still be results; these are looked up in all lists for exact
scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import forget, materialize, read

#: Results of a query.
MOST = 10
#: A term's list is dealt to so many parts by document, as a term may stand in every document.
SALTS = 16
#: A cell of the second phase has about so many documents, and queries.
CELL_DOCS, CELL_ITEMS = 1 << 12, 256
#: Bytes of texts whose postings are made together.
PART = 1 << 20

# What terms are made of, and the constants of the score.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LENGTH_SHARE, SATURATION, SCALE, WEIGHT = 75, 8, 1_000_000_000, 1000
#: Of the bytes of a text in UTF-8: all but ASCII letters and digits part terms; A-Z become small. Bytes over 0x7F belong to letters of terms.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def text_terms(text: str) -> list[bytes]:
    """The terms of a text in order."""
    return text.encode().translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """One row per document and different term of ``docs`` (row, doc_id, text): row, doc_id, n (terms of the document), term, tf."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < batch.num_rows:
                of, size, terms, tfs = [], [], [], []
                used = 0
                while at < batch.num_rows and used < PART:
                    text = texts[at].as_py()
                    if text:
                        words = text_terms(text)
                        found = Counter(words)
                        of += [at] * len(found)
                        size += [len(words)] * len(found)
                        terms += found.keys()
                        tfs += found.values()
                        used += len(text)
                    at += 1
                of = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(size, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], names=["row", "doc_id", "n", "term", "tf"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, n long, term string, tf long")


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many of ``docs`` (text) have a term, and how many terms all have, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms = 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n = len(text_terms(text.as_py() or ""))
                held, terms = held + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([terms])], names=["docs", "terms"])

    zero = F.lit(0).cast("long")
    return docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.coalesce(F.sum("docs"), zero), F.coalesce(F.sum("terms"), zero)).first()


def impact(n_docs: int, n_terms: int) -> Column:
    """What a term's occurrences in a document are worth, from columns tf and n."""
    longs = [F.lit(x).cast("long") for x in (LENGTH_SHARE, n_docs, max(1, n_terms))]
    m = F.lit(100 - LENGTH_SHARE).cast("long") + F.call_function("div", longs[0] * F.col("n") * longs[1], longs[2])
    return F.call_function("div", F.lit(SCALE).cast("long") * F.col("tf"), F.lit(1000).cast("long") * F.col("tf") + F.lit(SATURATION).cast("long") * m)


def query_terms(queries: DataFrame) -> DataFrame:
    """The terms of ``queries`` (item_id, text) with how often each query has them: item, item_id, term, times. ``item`` tells repeated rows apart."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = queries.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    rows = rows.select("item", "item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The lists of the terms of ``asked`` (term, list) in ``docs`` (doc_id, text), in the shared folder: list (a number), row, doc_id, n, tf.

    Lists are partitioned by term, and those parts by document, so that a term of all documents is no one's load alone; files
    are sorted by term. ``row`` tells repeated rows of ``docs`` apart.
    """
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    each = term_counts(numbered).join(asked, "term").select("list", "row", "doc_id", F.col("n").cast("int").alias("n"), F.col("tf").cast("int").alias("tf"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    return materialize(each.repartition("list", salt).sortWithinPartitions("list"), "postings")


def _kth(scores: DataFrame, name: str, most: int) -> DataFrame:
    """By item, the ``most``-th best sum of ``scores`` (item, row, sum), or none where there are fewer."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum"), "row"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("item").agg(F.max(F.when(F.col("rank") == most, F.col("sum"))).alias(name))


def _partial_sums(entries: DataFrame, lists: DataFrame, n_docs: int, n_items: int, most: int) -> DataFrame:
    """Sums of what was fetched, by query and document: item, row, sum; where ``bound`` is 0 the ``most`` best of each cell, else those that may reach it.

    ``entries`` (list, row, impact) meet the queries' ``lists`` (item, list, gain, m, low, slack, bound) in cells, of a block of
    queries and a part of the documents. A cell adds up by document what reaches the query's threshold; at best a document
    has slack / m more, and low / m less than that for each list it was seen in.
    """
    parts, blocks = max(1, -(-n_docs // CELL_DOCS)), max(1, -(-n_items // CELL_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None).cast("long")
    wanted = lists.select(block, "list").distinct()
    facts = ("item", "gain", "m", "low", "slack", "bound")
    rows = entries.join(wanted, "list").select("block", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "list", "row", "impact", *[none.alias(c) for c in facts])
    asked = lists.select(block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "list", none.alias("row"), none.alias("impact"), *facts)
    both = rows.unionByName(asked).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches, ["block", "part"]):
            n = int(np.searchsorted(cell["kind"], 1))
            if n == len(cell["kind"]) or not n:
                continue
            docs, at = np.unique(cell["row"][n:], return_inverse=True)
            impacts, of = cell["impact"][n:], cell["list"][n:]
            begins, ends = np.searchsorted(of, cell["list"][:n], "left"), np.searchsorted(of, cell["list"][:n], "right")
            order = np.argsort(cell["item"][:n], kind="stable")
            starts = np.flatnonzero(np.diff(cell["item"][:n][order], prepend=-1))
            for a, b in zip(starts, [*starts[1:], n]):
                mine = order[a:b]
                item, m, low, slack, bound = (int(cell[c][mine[0]]) for c in ("item", "m", "low", "slack", "bound"))
                sums, seen = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                for k in mine:
                    gain, here = int(cell["gain"][k]), slice(begins[k], ends[k])
                    fetched = impacts[here] >= -(-low // (m * gain))
                    to = at[here][fetched]
                    sums[to] += gain * impacts[here][fetched]  # a list has a document once
                    seen[to] += 1
                if bound:
                    keep = np.flatnonzero((seen > 0) & (m * sums + slack - seen * low >= m * bound))
                else:
                    keep = np.flatnonzero(seen)
                    keep = keep[np.argsort(-sums[keep], kind="stable")[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), item)), pa.array(docs[keep]), pa.array(sums[keep])], names=["item", "row", "sum"])

    return both.mapInArrow(run, "item long, row long, sum long")


def cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows with equal ``keys``; nulls as 0."""
    held: list[pa.RecordBatch] = []

    def done() -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(held)
        return {c: pc.fill_null(whole.column(c), 0).to_numpy() for c in whole.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1].column(k)[held[-1].num_rows - 1].as_py() != x[0]
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows and held:
                yield done()
                held = []
            at = cut
    if held:
        yield done()


def search(docs: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """The best documents of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text): item_id, rank, doc_id, score; other columns are ignored.

    Scores are whole numbers: a document's score is the sum over the query's terms, repeats included, of the term's weight
    times the impact of its occurrences (see :func:`impact`). Up to ``most`` documents with a score above 0, best first, equal
    scores by doc_id, null ids first; null and empty texts have no terms and are no results. Repeated rows are documents and queries of their own.
    """
    n_docs, n_terms = totals(docs)
    wanted = materialize(query_terms(queries), "query-terms")
    terms = materialize(wanted.select("term").distinct().withColumn("list", F.monotonically_increasing_id()), "query-lists")
    lists = postings(docs, terms)
    worth = impact(n_docs, n_terms)
    df = lists.groupBy("list").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    # a head has the best of a list, found part by part
    best = Window.partitionBy("list").orderBy(F.desc("impact"), "row")
    heads = lists.select("list", "row", worth.alias("impact")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    heads = materialize(heads, "list-heads")
    tops = heads.where("rank = 1").select("list", F.col("impact").alias("top"))
    # gain: what a unit of impact is worth to a query
    asked = wanted.join(terms, "term").join(df, "list").select("item", "item_id", "list", (F.col("times") * weight).alias("gain")).where("gain > 0").join(tops, "list")
    asked = materialize(asked, "query-gains")
    for done in (wanted, terms):
        forget(done)

    # phase 1: lower bounds from the heads
    sums = asked.join(heads.select("list", "row", "impact"), "list").groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("impact")).alias("sum"))
    bounds = asked.groupBy("item").agg(F.count("*").alias("m")).join(_kth(sums, "low", most), "item", "left").select("item", "m", F.coalesce("low", F.lit(0)).alias("low"))
    # slack: m times what lists give at best that were not fetched; each is under the threshold, and no more than its own best
    share = F.least(F.col("low"), F.col("m") * F.col("gain") * F.col("top"))
    reach = asked.join(bounds, "item").withColumn("slack", F.sum(share).over(Window.partitionBy("item")))
    # phase 2: in every list all that reaches the threshold low / m; lists whose best does not are not read
    open_ = materialize(reach.where(F.col("m") * F.col("gain") * F.col("top") >= F.col("low")).select("item", "list", "gain", "m", "low", "slack"), "query-bounds")
    forget(heads)
    at_least = F.ceil(F.col("low") / (F.col("m") * F.col("gain")).cast("double") * F.lit(1 - 1e-12)).cast("long")
    least = open_.groupBy("list").agg(F.min(at_least).alias("least"))
    fetched = lists.select("list", "row", worth.alias("impact")).join(least, "list").where(F.col("impact") >= F.col("least")).drop("least")
    n_items = open_.select("item").distinct().count()
    # the cells' best give the second bound, and with it each cell those that may still reach it; both read the lists again
    best_sums = _partial_sums(fetched, open_.withColumn("bound", F.lit(0).cast("long")), n_docs, n_items, most)
    second = materialize(_kth(best_sums, "bound", most), "query-second")
    bounded = open_.join(second, "item", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(1)), F.lit(1)))
    hopeful = _partial_sums(fetched, bounded, n_docs, n_items, most).select("item", "row")
    # phase 3: exact scores of those
    lookups = hopeful.join(asked.select("item", "item_id", "list", "gain"), "item")
    exact = lookups.join(lists.select("list", "row", "doc_id", worth.alias("impact")), ["list", "row"])
    scored = exact.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("gain") * F.col("impact")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


_SQL_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP13_SQL = f"""
WITH word AS (SELECT rid, doc_id, unnest(words) AS term, len(words)::BIGINT AS n FROM (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS words FROM documents WHERE text IS NOT NULL)
), posting AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM word GROUP BY ALL
), total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM (SELECT DISTINCT rid, n FROM posting)
), frequency AS (SELECT term, count(*) AS df FROM posting GROUP BY term
), asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_SQL_TERMS} AS words FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL
), gain AS (SELECT item, item_id, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS gain FROM asked JOIN frequency USING (term), total
), scored AS (
  SELECT item, item_id, rid, doc_id, sum(gain * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM gain JOIN posting USING (term), total GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, rid) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

"""Keeping the searchable page text up to date as new text items arrive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.search import page_text
from folioflow.sources import shared
from folioflow.sources.canonical import SCHEMAS


def append_page_text(spark: SparkSession, items_folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the page text of new files of text items to ``target``, laid out by batch and document.

    A page's items must come in one file, as a loader writes them; each batch groups its own pages, so no state is kept. A batch
    that is run again replaces what it wrote before. With ``once`` the query takes what is there and ends.
    """
    items = spark.readStream.schema(SCHEMAS["text_items"]).parquet(items_folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        page_text(batch).write.mode("overwrite").partitionBy("spec_id").parquet(f"{target}/batch={batch_id}")

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Folders that the state is dealt to, by document and page.
PARTS = 64
ITEM = SCHEMAS["text_items"] + ", arrived timestamp"
#: What the state has of a batch: its items, the texts of the pages that they touched, what came too late, and how far time has come.
ITEMS, TEXTS, LATE, CLOCK = "items", "pages", "late", "clock"


def upsert_page_text(spark: SparkSession, items_folder: str, state: str, checkpoint: str, delay: str | None = None, once: bool = True) -> StreamingQuery:
    """Keeps the text of pages up to date whose items come in any number of files, in any order: see :func:`current_pages`.

    Items are those of ``text_items`` with ``arrived``, a time. Of items with one (spec_id, page, seq) the last to arrive counts, of equal
    times the one of the later batch. With ``delay``, an interval, items that arrive earlier than that before the latest of the batches before are too late:
    they change no page and are kept in :func:`late_items`; items without a time are never late. Each batch writes its items
    and the new texts of the pages that they touch, of whose earlier items it reads those folders alone; a batch that is run
    again after a failure reads and writes the same. ``state`` is the folder of all this, for driver and executors.
    """
    items = spark.readStream.schema(ITEM).parquet(items_folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = [b for b in _batches(session, state, CLOCK) if b < batch_id]
        clock = reduce(DataFrame.unionByName, [session.read.schema("latest timestamp").parquet(_of(state, CLOCK, b)) for b in before]).agg(F.max("latest")).first()[0] if before else None
        bound = F.lit(None).cast("timestamp") if clock is None or delay is None else F.lit(clock) - F.expr(f"INTERVAL {delay}")
        is_late = F.coalesce(F.col("arrived") < bound, F.lit(False))
        part = F.pmod(F.xxhash64("spec_id", "page"), F.lit(PARTS)).cast("int")
        batch.where(is_late).write.mode("overwrite").parquet(_of(state, LATE, batch_id))
        batch.where(~is_late).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(_of(state, ITEMS, batch_id))
        new = _items(session, state, [batch_id])
        touched = new.select("part", "spec_id", "page").distinct()
        # folders of pages that the batch touched: at most PARTS numbers
        parts = [r.part for r in touched.select("part").distinct().collect()]
        known = _items(session, state, [b for b in _batches(session, state, ITEMS) if b <= batch_id]).where(F.col("part").isin(parts)).join(touched, ["part", "spec_id", "page"], "left_semi")
        latest = Window.partitionBy("spec_id", "page", "seq").orderBy(F.desc_nulls_last("arrived"), F.desc("batch"))
        rows = known.withColumn("n", F.row_number().over(latest)).where("n = 1")
        page_text(rows).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(_of(state, TEXTS, batch_id))
        # last, as it says that the batch is whole
        session.createDataFrame([(clock,)], "latest timestamp").unionByName(batch.agg(F.max("arrived").alias("latest"))).agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(_of(state, CLOCK, batch_id))

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _of(state: str, what: str, batch: int) -> str:
    return f"{state}/{what}/{batch}"


def _batches(spark: SparkSession, state: str, what: str) -> list[int]:
    return sorted(int(b) for b in shared.folders(spark, f"{state}/{what}") if b.isdigit())


def _union(spark: SparkSession, state: str, what: str, schema: str, batches: list[int]) -> DataFrame:
    found = [spark.read.schema(schema).parquet(_of(state, what, b)).withColumn("batch", F.lit(b)) for b in batches]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"{schema}, batch int")


def _items(spark: SparkSession, state: str, batches: list[int]) -> DataFrame:
    return _union(spark, state, ITEMS, f"{ITEM}, part int", batches)


def current_pages(spark: SparkSession, state: str) -> DataFrame:
    """The pages as of the last whole batch (spec_id, page, text): of each page the text of the last batch that touched it."""
    whole = _union(spark, state, TEXTS, "spec_id string, page int, text string, part int", _batches(spark, state, CLOCK))
    return whole.groupBy("spec_id", "page").agg(F.max_by("text", "batch").alias("text"))


def late_items(spark: SparkSession, state: str) -> DataFrame:
    """The items that came too late, with their batch."""
    return _union(spark, state, LATE, ITEM, _batches(spark, state, CLOCK))


def compact(spark: SparkSession, state: str) -> None:
    """Makes the whole batches one, the last: its items are those that count, its texts all pages'. Not while the query runs.

    What came too late stays by batch, as it is not read by any batch.
    """
    done = _batches(spark, state, CLOCK)
    if len(done) < 2:
        return
    last = done[-1]
    latest = Window.partitionBy("spec_id", "page", "seq").orderBy(F.desc_nulls_last("arrived"), F.desc("batch"))
    rows = _items(spark, state, done).withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n", "batch")
    part = F.pmod(F.xxhash64("spec_id", "page"), F.lit(PARTS)).cast("int")
    for what, df in ((ITEMS, rows), (TEXTS, current_pages(spark, state).withColumn("part", part))):
        df.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state}/{what}/new-{last}")
    for what in (ITEMS, TEXTS):
        for b in done:
            shared.delete(spark, _of(state, what, b))
        shared.rename(spark, f"{state}/{what}/new-{last}", _of(state, what, last))
    for b in done[:-1]:  # the last clock knows the latest time of all
        shared.delete(spark, _of(state, CLOCK, b))

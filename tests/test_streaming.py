"""Page text kept up to date over many files, against the text of all items at once."""

import datetime as dt
import random

from folioflow.operators.search import page_text
from folioflow.sources import canonical
from folioflow.streaming import pages as sp

DAY = dt.datetime(2024, 5, 1)


def put(spark, folder, rows):
    """Rows (spec_id, page, seq, str, minutes)."""
    made = [(s, p, n, "text", None, t, False, None if m is None else DAY + dt.timedelta(minutes=m)) for s, p, n, t, m in rows]
    spark.createDataFrame(made, sp.ITEM).coalesce(1).write.mode("append").parquet(folder)


def step(spark, tmp, **options):
    sp.upsert_page_text(spark, f"{tmp}/in", f"file://{tmp}/state", f"{tmp}/ck", **options).awaitTermination(120)


def now(spark, tmp):
    return {(r.spec_id, r.page): r.text for r in sp.current_pages(spark, f"file://{tmp}/state").collect()}


def test_a_page_over_three_files_and_a_late_one(spark, tmp_path):
    rng = random.Random(1)
    every = [("d", page, seq, f"w{page}-{seq}", rng.randint(0, 50)) for page in range(6) for seq in range(9)]
    rng.shuffle(every)
    for k in range(3):  # each run of the query is a new one, which goes on from the checkpoint
        put(spark, f"{tmp_path}/in", every[k::3])
        step(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [("d", 2, 4, "new", 90), ("d", 3, 4, "old", -5), ("e", 1, 1, "x", None)])
    step(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [("d", 5, 1, "late", 20), ("d", 5, 2, "in time", 85), ("d", 5, 3, "untimed", None)])
    step(spark, tmp_path, delay="10 MINUTES")
    best = {}
    for s, p, n, t, m in [*every, ("d", 2, 4, "new", 90), ("d", 3, 4, "old", -5), ("e", 1, 1, "x", None), ("d", 5, 2, "in time", 85), ("d", 5, 3, "untimed", None)]:
        key = (m is not None, m)
        if (s, p, n) not in best or key >= best[s, p, n][0]:
            best[s, p, n] = (key, t)
    rows = spark.createDataFrame([(s, p, n, "text", None, t, False) for (s, p, n), (_, t) in best.items()], canonical.SCHEMAS["text_items"])
    want = {(r.spec_id, r.page): r.text for r in page_text(rows).collect()}
    assert now(spark, tmp_path) == want and "late" not in want["d", 5] and "in time" in want["d", 5] and "new" in want["d", 2]
    assert [(r.page, r.str) for r in sp.late_items(spark, f"file://{tmp_path}/state").collect()] == [(5, "late")]
    # a batch that failed before it was whole is run again, and gives the same
    for name in ("4", ".4.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    sp.shared.delete(spark, f"file://{tmp_path}/state/clock/4")
    assert now(spark, tmp_path) != want
    step(spark, tmp_path, delay="10 MINUTES")
    assert now(spark, tmp_path) == want
    sp.compact(spark, f"file://{tmp_path}/state")
    assert now(spark, tmp_path) == want and len(list((tmp_path / "state" / "items").glob("[0-9]*"))) == 1
    put(spark, f"{tmp_path}/in", [("d", 2, 0, "first", 95), ("d", 0, 0, "too late", 1)])
    step(spark, tmp_path, delay="10 MINUTES")
    got = now(spark, tmp_path)
    assert got["d", 2] == "first " + want["d", 2].partition(" ")[2] and got["d", 0] == want["d", 0]


def test_no_items(spark, tmp_path):
    (tmp_path / "in").mkdir()
    step(spark, tmp_path)
    assert now(spark, tmp_path) == {} and sp.late_items(spark, f"file://{tmp_path}/state").collect() == []
    sp.compact(spark, f"file://{tmp_path}/state")

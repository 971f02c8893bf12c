"""Running values span by span, against running values at once."""

import random

from pyspark.sql import functions as F

from folioflow.operators import spans, tables

ROWS = "spec_id string, section string, at long, kind string, value int"


def test_last_and_count(spark, monkeypatch):
    rng, rows, want = random.Random(1), [], []
    for section in ("a", "b", None):
        last, n = None, 0
        for at in sorted(rng.sample(range(100), 40)):
            value = rng.choice([None, None, rng.randint(0, 9)])
            n += (value or 0) % 2
            rows.append(("d", section, at, "k", value))
            want.append(("d", section, at, last, n))
            last = last if value is None else value
    df = spark.createDataFrame(rows, ROWS)
    for span in (1, 7, 1000):
        monkeypatch.setattr(spans, "SPAN", span)
        got = spans.last_before(df, ["spec_id", "section"], "at", {"last": F.col("value")})
        got = spans.count_so_far(got, ["spec_id", "section"], "at", "n", F.col("value") % 2 == 1)
        assert sorted(map(tuple, got.select("spec_id", "section", "at", "last", "n").collect()), key=repr) == sorted(want, key=repr)


def test_one_section_of_all_rows(spark):
    """No task sorts a whole section: windows are by span, and what crosses spans is a row each."""
    n = 3 * spans.SPAN
    body = spark.range(n).select(F.lit("d").alias("spec_id"), F.lit("s").alias("section"), F.col("id").alias("elem_ord"), F.when(F.col("id") % 2 == 0, "paragraph").otherwise("table").alias("type"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("Table "), "id")).otherwise("words").alias("text"))
    body = body.withColumn("headers", F.when(F.col("type") == "table", F.array(F.lit("h")))).withColumn("rows", F.when(F.col("type") == "table", F.array(F.array(F.col("elem_ord").cast("string")))))
    found = tables.tagged_tables(body)
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()
    for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
        if "windowspecdefinition" in line and "_span" not in line.split("windowspecdefinition")[1]:
            raise AssertionError(line)
    got = found.select("index", "caption", F.size("rows").alias("n")).orderBy("index").collect()
    assert [(r["index"], r.caption, r.n) for r in got] == [(k, f"Table {k * 1000}", min(1000, n - k * 1000) // 2) for k in range(-(-n // 1000))]

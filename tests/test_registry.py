"""Finding documents: listings, their changes, and what is told on the error stream."""

import os

import pytest

from folioflow.functions.errors import RegistryError
from folioflow.functions.log import DEBUG, logger
from folioflow.sources import registry

NAMES = ("PDF32000_2008.pdf", "a-PDF32000_2008.pdf", "notes.txt", "ISO_TS_32001-2022.pdf", "PDF20_AN002-af.PDF", "other.pdf")


def test_rules_as_constants_and_as_a_table(spark):
    names = [*NAMES, "x" + NAMES[0], "ISO_32000-2_sponsored-ec2.pdf", "iso-ts-32004.pdf", "ISO-14289-2-2024.pdf", "", None]
    files = spark.createDataFrame([(n,) for n in names], "filename string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(registry.classify(files)) == key(registry.classify(files, registry.rules(spark))) != []


def test_three_listings(spark, tmp_path):
    def put(name, text, at):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))

    for name in NAMES:
        put(name, "x", 1_700_000_000)
    first = spark.createDataFrame(registry.list_files(spark, str(tmp_path)).collect(), "path string, filename string, length long, modified timestamp")
    specs = registry.classify(first)
    stats = spark.createDataFrame([("pdf17", 10, 3), ("ts32001", 20, 4), ("an002", 30, 5)], "spec_id string, pages int, outline_entries int")
    specs = spark.createDataFrame(registry.enrich(specs, stats).collect(), specs.schema)
    assert {r.spec_id: r.pages for r in specs.collect()} == {"pdf17": 10, "ts32001": 20, "an002": 30}

    put("ISO_TS_32001-2022.pdf", "xx", 1_700_000_000)  # another length
    put("PDF20_AN003-om.pdf", "x", 1_700_000_000)
    (tmp_path / "PDF32000_2008.pdf").unlink()  # another file stands for its document now
    now = registry.list_files(spark, str(tmp_path))
    changed = registry.changes(first, now)
    assert sorted((r.path.rpartition("/")[2], r.change) for r in changed.collect()) == [("ISO_TS_32001-2022.pdf", "changed"), ("PDF20_AN003-om.pdf", "new"), ("PDF32000_2008.pdf", "gone")]
    got = registry.refresh(specs, now, changed)
    assert got.columns == specs.columns
    assert {r.spec_id: (r.filename, r.pages) for r in got.collect()} == {"pdf17": ("a-PDF32000_2008.pdf", None), "ts32001": ("ISO_TS_32001-2022.pdf", None), "an002": ("PDF20_AN002-af.PDF", 30), "an003": ("PDF20_AN003-om.pdf", None)}

    second = spark.createDataFrame(now.collect(), first.schema)
    put("PDF20_AN002-af.PDF", "x", 1_800_000_000)  # another time
    changed = registry.changes(second, registry.list_files(spark, str(tmp_path)))
    assert [(r.path.rpartition("/")[2], r.change) for r in changed.collect()] == [("PDF20_AN002-af.PDF", "changed")]


def test_folders_that_cannot_be_read_are_named(spark, tmp_path):
    with pytest.raises(RegistryError, match="is set"):
        registry.list_files(spark, None)
    with pytest.raises(RegistryError, match="nowhere"):
        registry.list_files(spark, str(tmp_path / "nowhere"))


def test_messages(capsys, monkeypatch):
    monkeypatch.delenv(DEBUG, raising=False)
    logger("a").debug("hidden %s", 1)
    logger("a").error("shown %s", 2)
    monkeypatch.setenv(DEBUG, "1")
    logger("b").debug("shown %s", 3)
    out = capsys.readouterr()
    assert out.out == "" and out.err.splitlines() == ["[ERROR] folioflow.a: shown 2", "[DEBUG] folioflow.b: shown 3"]

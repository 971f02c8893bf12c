"""The substring index against the search that reads every text."""

import random

import pytest

from folioflow.operators import grams, search
from folioflow.sources import shared

PAGES = "spec_id string, page int, section string, text string"
QUERIES = ["the", "of  THE", " to", "a", "ZZ - q", "x́y", "🎉👍", "nothing like it", "ab ab cd", "of", "e t"]


def pages(n, seed, spec="d"):
    rng = random.Random(seed)
    words = ["the", "of", "on", "fire", "Firefly", "zz-q", "zz  -\nq", "x́y", "🎉👍", "to", "in", "É", "abcd", "ab", "cd", "　"]
    return [(spec + str(i % 3), i, rng.choice(["", "s1", "s2", f"p{i}"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("spec_id", "page", "section", "score", "snippet").collect()), key=repr)


@pytest.fixture(scope="module")
def built(spark):
    data = pages(150, 1) + [("d0", 900, "", None), ("d0", 901, "s9", ""), ("d1", 902, "long", "ab " * 5000 + "needle in it" + " cd" * 3000)]
    folder = shared.new_folder(spark, "grams-test")
    df = spark.createDataFrame(data, PAGES)
    grams.add(df.repartition(3), folder, "b1")
    return df, folder


@pytest.mark.parametrize("query", [*QUERIES, "needle in", "dle in it cd"])
def test_same_rows_as_reading_all(spark, built, query):
    df, folder = built
    for most, per_spec in ((None, True), (3, False)) if query == "of  THE" else ((None, True),):
        assert rows(grams.search(spark, folder, query, most, per_spec)) == rows(search.search(df, query, most, per_spec))


def test_many_candidates_are_joined(spark, built, monkeypatch):
    monkeypatch.setattr(grams, "LOOKUPS", 3)
    df, folder = built
    for query in ("the", "of  THE", "needle in"):
        assert rows(grams.search(spark, folder, query, None)) == rows(search.search(df, query, None))


def test_rare_grams_read_few_texts(spark, built):
    df, folder = built
    for query in QUERIES + ["needle in"]:
        found, hits = grams.candidates(spark, folder, query), search.score_pages(df, query).count()
        if found is None:
            assert not grams.query_grams(query)
        else:
            assert hits <= found.count() < 154
    assert grams.candidates(spark, folder, "needle in").count() == 1
    assert grams.candidates(spark, folder, "nothing like it").count() == 0
    plan = grams.search(spark, folder, "needle in", None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(span" in plan and "PushedFilters" in plan


def test_batches_are_appended_and_merged(spark, monkeypatch):
    monkeypatch.setattr(grams, "SPAN", 16)  # spans end inside a task's rows
    folder, parts = shared.new_folder(spark, "grams-test"), [pages(40, k, f"k{k}-") for k in (2, 3)]
    for k, part in enumerate(parts):
        grams.add(spark.createDataFrame(part, PAGES), folder, f"b{k}")
    grams.add(spark.createDataFrame(parts[1], PAGES), folder, "b1")  # again: no page twice
    df = spark.createDataFrame(parts[0] + parts[1], PAGES)
    want = {q: rows(search.search(df, q, None)) for q in ("the", "of on", "zz-q")}
    assert {q: rows(grams.search(spark, folder, q, None)) for q in want} == want
    with pytest.raises(ValueError, match="b1"):
        grams.merge(spark, folder, "b1")
    grams.merge(spark, folder, "m")
    assert grams.batches(spark, folder) == ["m"]
    assert {q: rows(grams.search(spark, folder, q, None)) for q in want} == want
    changed = [(s, p, sec, "quite new words") for s, p, sec, _ in parts[0][:5]]
    grams.add(spark.createDataFrame(changed, PAGES), folder, "n")
    grams.merge(spark, folder, "o")
    df = spark.createDataFrame(changed + parts[0][5:] + parts[1], PAGES)
    assert rows(grams.search(spark, folder, "new words", None)) == rows(search.search(df, "new words", None))
    assert rows(grams.search(spark, folder, "the", None)) == rows(search.search(df, "the", None))


def test_empty_index(spark):
    folder = shared.new_folder(spark, "grams-test")
    assert rows(grams.search(spark, folder, "the", None)) == []
    grams.merge(spark, folder, "m")
    grams.add(spark.createDataFrame([], PAGES), folder, "b")
    assert rows(grams.search(spark, folder, "the", None)) == []

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, h string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[i].add(j)
                links[j].add(i)
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            k = todo.pop()
            for j in links[k]:
                if comp[j] > comp[i]:
                    comp[j] = comp[i]
                    todo.append(j)
    least = {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[comp[i]], len(links[i])) for i in range(len(rows)))


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for group in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 400))))
        for copy in range(int(rng.integers(1, 40))):
            mine = list(words)
            for at in rng.choice(len(mine), int(rng.integers(0, 1 + len(mine) // 30)), replace=False):
                mine[at] = str(rng.choice(vocabulary))
            rows.append((n, " ".join(mine)))
            n += 1
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.class_id, r.n_links) for r in nj.ngram_join(docs).collect())


def test_random_near_copies_against_all_pairs(spark, monkeypatch):
    rows = near_copies() + [(9000, ""), (9001, None), (9002, "a b"), (9003, "a  b\n"), (9004, "x"), (9005, " \t")]
    rows += [(9100 + i, t) for i, (_, t) in enumerate(near_copies()[:30])]
    monkeypatch.setattr(nj, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(nj, "BUCKET_BLOCK", 8)
    got = run(spark, rows)
    assert [g for g in got if g[0] < 9000 or g[0] >= 9100] == [w for w in brute([(i, t) for i, t in rows if t]) if w[0] < 9000 or w[0] >= 9100]
    assert [g for g in got if 9000 <= g[0] < 9100] == [(9000, 9000, 0), (9001, 9001, 0), (9002, 9002, 1), (9003, 9002, 1), (9004, 9004, 0), (9005, 9005, 0)]


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    same = "one two three four five six seven"
    got = run(spark, [(1, same), (1, same), (3, same)])
    assert got == [(1, 1, 2), (1, 1, 2), (3, 1, 2)]
    docs = spark.createDataFrame([(None, same, "x"), (None, "other words that stand here alone", "x"), (4, same, "x")], SCHEMA)
    assert {(r.doc_id, r.class_id, r.n_links) for r in nj.ngram_join(docs).collect()} == {(None, 4, 1), (4, 4, 1), (None, None, 0)}
    assert nj.ngram_join(docs.limit(0)).collect() == []


def test_long_text_in_slices(monkeypatch):
    words = [f"word{i % 977}é" for i in range(20000)]
    texts = pa.array([" ".join(words), "short text", None or "", "\n".join(words)])
    whole = list(nj.shingle_sets(texts))
    monkeypatch.setattr(nj, "SLICE", 100)
    cut = list(nj.shingle_sets(texts))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert (whole[0] == whole[3]).all() and len(whole[0]) == len(shingles(" ".join(words))) and len(whole[2]) == 0


def test_pruning_bound():
    assert nj.least_matches(32) < 0.8 * 32
    for n, m in nj.LEAST.items():
        assert 0 < m < 0.8 * n
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (50, nj.HASHES)).astype(np.uint16)
    b = a.copy()
    b[:25, ::2] = 0
    assert list(nj.survivors(a, b)) == list(range(25, 50))

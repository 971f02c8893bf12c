import math
import random
import re
from collections import Counter

import duckdb

from folioflow.llm import lexical as lx

DOCS, ITEMS = "doc_id long, text string, term string, row int", "item_id long, text string, doc_id int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(lx.TERM, text or "")]


def brute(docs, items, most=10):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c, _ in counts if c), sum(k for _, _, k in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for place, (i, c, k) in enumerate(counts):
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + 75 * k * n // total))) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i, place))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i, _) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=repr)


def run(spark, docs, items, most=10):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = lx.search(d, q, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "ß", "Straße", "日本", "A1", "İx"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(k):
        return "".join(w.upper() * (rng.random() < 0.1) or w + rng.choice([" ", "\n", "--", "_", "\x7f", ". "]) for w in rng.choices(vocabulary, weights, k=k))

    return [(i, text(rng.choice([1, 3, 10, 80]))) for i in range(n)], [(i, text(rng.choice([1, 4, 30]))) for i in range(15)]


def test_search_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(250, seed)
        assert run(spark, docs, items) == brute(docs, items)
        assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_odd_rows(spark):
    same = "alpha beta gamma delta"
    docs = [(i, same) for i in range(30, 0, -1)] + [(1, same), (None, same + " rare"), (40, None), (41, ""), (42, "-- ,,"), (43, "alpha " * 3000), (44, "ALPHA Rare rare")]
    items = [(1, "alpha rare"), (1, "alpha rare"), (2, None), (3, ""), (4, "nothing here"), (None, "gamma"), (5, "rare rare RARE"), (6, "é È")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == []


def test_terms_of_every_character(spark):
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([*range(0x20, 0x180), *range(0x2000, 0x2070), 0x1F600, 0x0, 0xA, 0x0130, 0x212A])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert [w.decode() for w in lx.text_terms(t)] == terms(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert tuple(lx.totals(docs)) == (sum(1 for t in texts if terms(t)), sum(len(terms(t)) for t in texts))


def test_common_terms_are_not_read(spark):
    """Lists whose best cannot reach the threshold stay shut: results come from rare terms."""
    docs = [(i, "the of and " + (f"rare{i % 20} " if i < 200 else "") * 3 + "pad " * (i % 7)) for i in range(2000)]
    items = [(i, f"the of and rare{i} pad") for i in range(20)]
    assert run(spark, docs, items) == brute(docs, items)


def test_sql_on_a_table_with_hard_rows(spark):
    docs, items = corpus(120, 9)
    docs += [(7, docs[7][1]), (500, None), (501, "")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.sql(lx.OP13_SQL).select("item_id, rank, doc_id, score").fetchall(), key=repr) == run(spark, docs, items)


def test_small_cells_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lx, "CELL_DOCS", 30)
    monkeypatch.setattr(lx, "CELL_ITEMS", 2)
    docs, items = corpus(200, 5)
    assert run(spark, docs, items) == brute(docs, items)


def test_cells_of_batches():
    rng = random.Random(6)
    keys = sorted((rng.randint(0, 6), rng.randint(0, 3), k) for k in range(60))
    table = lx.pa.table({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "v": [k[2] for k in keys]})
    for size in (1, 4, 7, 100):
        got = [(int(c["a"][0]), int(c["b"][0]), c["v"].tolist()) for c in lx.cells(iter(table.to_batches(max_chunksize=size)), ["a", "b"])]
        want = {}
        for a, b, v in keys:
            want.setdefault((a, b), []).append(v)
        assert got == [(a, b, v) for (a, b), v in want.items()]

import numpy as np

from folioflow.llm import embed_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(good)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a + 1, n):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                link[a, b] = link[b, a] = True
    label = [i for i, _ in good]
    for _ in range(n):
        new = [min([label[a], *(label[b] for b in np.flatnonzero(link[a]))]) for a in range(n)]
        if new == label:
            break
        label = new
    out = {i: (0, i) for i, _ in rows}
    out.update({good[a][0]: (int(link[a].sum()), label[a]) for a in range(n)})
    return out


def run(spark, rows, **options):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    out = ed.embed_dedup(vectors, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def cloud(n, dim, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + rng.normal(size=dim) * spread * rng.random()
        out.append((1000 - i, [float(x) for x in v.astype(np.float32)]))
    return out


def test_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK_BYTES", 1)
    for dim in (3, 12):  # few dimensions: most links cross cells
        rows = cloud(300, dim, dim)
        assert run(spark, rows, cells=9) == brute(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (10, [1.0, 1.0, 0.0]), (11, [1e-30, 1e-30]), (12, [-1.0, -1.0]), (13, [3e38, 3e38])]
    got = run(spark, rows)
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (4, 7), 8: (4, 7), 9: (4, 7), 10: (0, 10), 11: (4, 7), 12: (0, 12), 13: (4, 7)}


def test_one_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.99, 0.05]), (2, [1.0, 0.01]), (1, [0.0, 1.0]), (3, [0.01, 1.0]), (0, [-1.0, 0.0]), (1, [-1.0, -1.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.embed_dedup(vectors).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_repeated_rows_null_ids_and_no_rows(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x")], SCHEMA)
    assert sorted(map(tuple, ed.embed_dedup(vectors).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert ed.embed_dedup(vectors.limit(0)).collect() == []


def test_table_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embed_dedup(table).collect()}
    assert got == brute(rows)

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import exact_dedup as ex
from folioflow.llm import line_dedup as ld
from folioflow.llm import mixing as mx
from folioflow.llm.components import components

DOCS = "doc_id long, text string, source string, h long, size long, kept string, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x", "y") for i, t, s in rows], DOCS)


# --- exact dedup

def test_exact_dedup_with_splitting_buckets(spark):
    rows = [(i, f"text {i % 137}" if i % 3 else f"only {i}", "s") for i in range(500)] + [(600, None, "s"), (601, "", "s"), (602, " ", "s"), (602, " ", "s"), (None, " ", "s")]
    docs = docs_of(spark, rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    for capacity, depth in ((100_000, 20), (10, 12), (1, 3)):  # one bucket, many, and overfull ones that cannot split further
        got = ex.exact_dedup(docs, capacity, depth).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_directory_buckets_cover_keys_once(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for capacity in (5000, 100, 7):
        buckets = ex.buckets_of(keys, capacity)
        rows = buckets.collect()
        assert sum(b.n for b in rows) == 3000 and all(b.n <= capacity for b in rows)
        spans = sorted(((b.slot << (64 - b.depth)) if b.depth else 0, 1 << (64 - b.depth)) for b in rows)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        directory = ex.Directory.of(buckets)
        slots = directory.slots.collect()
        assert len({x.slot for x in slots}) == len(slots) <= 1 << directory.depth
        dealt = directory.deal(keys).groupBy("bucket").count().collect()
        assert sorted(x["count"] for x in dealt) == sorted(b.n for b in rows if b.n)


def test_colliding_hashes_are_chained_and_the_directory_decides(spark, monkeypatch):
    rows = [(i, f"text {i % 211}", "s") for i in range(400)]
    docs = docs_of(spark, rows)
    last, size = {}, Counter(t for _, t, _ in rows)
    for i, t, _ in rows:
        last[t] = i

    def key(text):  # four bits: many different texts of one hash
        return F.shiftleft(F.pmod(F.crc32(text), F.lit(16)), 60)

    assert max(len(r.chain) for r in ex.build_index(docs, 5, 20, key).chains.collect()) > 5
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ex.exact_dedup(docs, 5, 20, key).collect()}
    assert got == {i: (last[t], size[t]) for i, t, _ in rows}
    whole = ex.Directory.of
    monkeypatch.setattr(ex.Directory, "of", staticmethod(lambda b: ex.Directory(whole(b).depth, whole(b).slots.where("slot % 2 = 0"))))
    assert 0 < ex.exact_dedup(docs, 5, 20, key).count() < len(rows)  # rows of slots that the directory lacks are lost


def test_drop_copies_keeps_whole_rows(spark):
    docs = docs_of(spark, [(1, "a", "s"), (5, "a", "t"), (5, "a", "t"), (2, None, "s"), (None, "", "s"), (None, "b", "u")])
    got = ex.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.source, r.row) for r in got.collect()) == [("2", None, "s", "y"), ("5", "a", "t", "y"), ("None", "b", "u", "y")]
    assert ex.drop_copies(docs.limit(0)).collect() == [] and ex.exact_dedup(docs.limit(0)).collect() == []


# --- lines

def brute_lines(rows, least):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line].add(s)
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        gone = [x for x in lines if x.strip(" ") and len(sites[x]) >= least]
        out.append((str(i), None if t is None else "\n".join(x for x in lines if x not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def test_line_dedup_near_the_threshold(spark):
    rows = []
    for n in range(2, 14):  # line n is on n sites
        rows += [(n * 100 + s, f"own {n} {s}\nshared {n}\n\nshared {n}", f"site{s}") for s in range(n)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "\n", None), (9003, "shared 13", None), (9003, "shared 13", None), (None, "x\nshared 12", "q")]
    docs = docs_of(spark, rows)
    for least in (3, 10):
        got = ld.dedup_lines(docs, min_sites=least)
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute_lines(rows, least)
    assert set(docs.columns) < set(got.columns)
    assert ld.dedup_lines(docs.limit(0)).collect() == []


# --- mixing

def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not full:
            return out | {s: left * weights[s] / w for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [[100, 1, 1, 1], [5, 50, 500, 5000, 50000], [7] * 9, [0, 10, 3]])
def test_water_filling_against_clamping_in_turns(spark, sizes):
    rows = [(i, "w " * n, f"s{i:02d}" if i else None) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mx.mix(docs_of(spark, rows)).collect()}
    want = plain_targets({f"s{i:02d}" if i else None: n for i, n in enumerate(sizes)})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_takes_what_the_targets_say(spark):
    rows = [(i, f"word\t{i} " * (1 + i * 37 % 60), f"s{i % 7}") for i in range(700)] + [(7000, None, "s1"), (7001, "", "s1"), (None, "a b c", None), (7002, "x y", None)]
    docs = docs_of(spark, rows)
    got = mx.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= max(3, 0.002 * target[s])  # far less than half a document
    again = mx.mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in got) == sorted((str(r.doc_id), r.copies) for r in again)
    repeated = mx.mixed(docs)
    assert repeated.columns == docs.columns
    assert Counter(str(r.doc_id) for r in repeated.collect()) == Counter({str(r.doc_id): r.copies for r in got if r.copies})
    assert mx.mix(docs.limit(0)).collect() == []


# --- components

def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (300, 300), (400, 500), (401, 500), (402, 500), (402, 401)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 150: 100, 300: 300, 400: 400, 401: 400, 402: 400, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []

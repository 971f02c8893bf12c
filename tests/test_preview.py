"""What changed inside matched sections, against a plain difference."""

import random
from collections import Counter

from folioflow.operators import compare

COMPARED = "kind string, old_section string, new_section string, title string"
CONTENT = "section string, elem_ord int, text string, page int"


def rising(j):
    """The length of a longest rising run, pair by pair."""
    best = []
    for k, x in enumerate(j):
        best.append(1 + max((best[i] for i in range(k) if j[i] < x), default=0))
    return max(best, default=0)


def check(a, b, got):
    """``got`` rows (kind, i, j, text) for the texts a and b by place."""
    kept = sorted((i, j) for kind, i, j, _ in got if kind == "kept")
    assert all(a[i] == b[j] == t for kind, i, j, t in got if kind == "kept") and all(x[1] < y[1] for x, y in zip(kept, kept[1:]))
    gone, come = [i for kind, i, _, _ in got if kind == "removed"], [j for kind, _, j, _ in got if kind == "added"]
    assert sorted([i for i, _ in kept] + gone) == list(range(len(a))) and sorted([j for _, j in kept] + come) == list(range(len(b)))
    n_a, n_b = Counter(a), Counter(b)
    anchors = [i for i in range(len(a)) if n_a[a[i]] == n_b[a[i]] == 1]
    firm = [(i, j) for i, j in kept if i in set(anchors)]
    assert len(firm) == rising([b.index(a[i]) for i in anchors])
    want = list(firm)
    for (i0, j0), (i1, j1) in zip([(-1, -1), *firm], [*firm, (len(a), len(b))]):
        i, j = i0 + 1, j0 + 1
        while i < i1 and j < j1 and a[i] == b[j]:
            want.append((i, j))
            i, j = i + 1, j + 1
        x, y = i1 - 1, j1 - 1
        while x >= i and y >= j and a[x] == b[y]:
            want.append((x, y))
            x, y = x - 1, y - 1
    assert sorted(want) == kept


def test_random_sections(spark):
    rng, cases = random.Random(1), {}
    for case in range(60):
        a = [f"t{rng.randint(0, rng.choice([3, 12, 60]))}" for _ in range(rng.randint(0, 25))]
        b = [t for t in a if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), f"t{rng.randint(0, 70)}")
        if rng.random() < 0.5:
            x, y = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
            b = b[y:] + b[:x] + b[x:y] if rng.random() < 0.5 else b[::-1]
        cases[f"s{case}"] = (a, b)
    rows = [spark.createDataFrame([(s, k * 3 + 1, t, 1) for s, ab in cases.items() for k, t in enumerate(ab[side])], CONTENT) for side in (0, 1)]
    compared = spark.createDataFrame([("matched", s, s, "x") for s in cases] + [("added", None, "s0", "x"), ("removed", "s1", None, "x")], COMPARED)
    got = {s: [] for s in cases}
    for r in compare.preview(compared, *rows).collect():
        place = lambda n: None if n is None else (n - 1) // 3
        got[r.old_section].append((r.kind, place(r.old_ord), place(r.new_ord), r.text))
    for s, (a, b) in cases.items():
        check(a, b, got[s])


def test_numbers_that_moved_and_odd_rows(spark):
    old = spark.createDataFrame([("1", 1, "a", 1), ("1", 2, None, 1), ("1", 3, "b", 1), ("2", 1, "q", 1)], CONTENT)
    new = spark.createDataFrame([("7", 1, "b", 1), ("7", 2, "", 1), ("8", 1, "a", 1)], CONTENT)
    compared = spark.createDataFrame([("matched", "1", "7", "t"), ("matched", "1", "7", "t"), ("matched", "5", "8", "t")], COMPARED)
    got = sorted(map(tuple, compare.preview(compared, old, new).collect()), key=repr)
    assert got == sorted([("1", "7", "removed", 1, None, "a"), ("1", "7", "kept", 3, 1, "b"), ("1", "7", "added", None, 2, ""), ("5", "8", "added", None, 1, "a")], key=repr)
    assert compare.preview(compared.limit(0), old, new).collect() == []

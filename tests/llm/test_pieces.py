import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from folioflow.llm import pieces as p

VOCABULARY = p.Vocabulary.load()
ALPHA = 0.5


def spell(ids):
    byte_of = {i: bytes([b]) for b, i in enumerate(VOCABULARY.byte_ids)}
    return b"".join(byte_of.get(i) or VOCABULARY.pieces[i].replace(p.SPACE, " ").encode() for i in ids).decode()[1:]


def all_paths(text):
    """Every segmentation of a text with its probability, by trying all cuts."""
    index = {x: i for i, x in enumerate(VOCABULARY.pieces) if i not in VOCABULARY.special}
    chars = p.SPACE + text.replace(" ", p.SPACE)
    out = {}

    def go(at, ids, w):
        if at == len(chars):
            out[tuple(ids)] = w
        for end in range(at + 1, len(chars) + 1):
            if (i := index.get(chars[at:end])) is not None:
                go(end, [*ids, i], w + ALPHA * VOCABULARY.log_p[i])

    go(0, [], 0.0)
    total = math.log(sum(math.exp(w) for w in out.values()))
    return {k: w - total for k, w in out.items()}


def sample(texts, samples, seeds=None):
    keys = np.array(seeds if seeds is not None else range(len(texts)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = p.sample_texts(p.Lattices(VOCABULARY, ALPHA), texts, keys, samples)
    ends = got["n"].cumsum()
    rows = {}
    for d, s, w, q, n, e in zip(got["doc"], got["sample"], got["log_p"], got["inclusion"], got["n"], ends, strict=True):
        rows.setdefault(int(d), []).append((tuple(got["ids"][e - n : e].tolist()), float(w), float(q)))
    return rows


def test_samples_are_distinct_segmentations_with_their_probabilities():
    text = "a token"
    every = all_paths(text)
    for k in (1, 2, 5):
        for rows in sample([text] * 40, k).values():
            assert len({r[0] for r in rows}) == len(rows) == k
            assert all(abs(every[ids] - w) < 1e-9 and 0 < q <= 1 for ids, w, q in rows)


def test_all_segmentations_when_there_are_few():
    text = "it"
    every = all_paths(text)
    for rows in sample([text] * 30, len(every) + 3).values():
        assert {r[0] for r in rows} == set(every)
        assert all(q == 1 for _, _, q in rows)


def test_order_follows_sampling_without_replacement():
    text = "to be"
    every = all_paths(text)
    n = 6000
    rows = sample([text] * n, 2)
    first, pairs = {}, {}
    for r in rows.values():
        first[r[0][0]] = first.get(r[0][0], 0) + 1
        pairs[r[0][0], r[1][0]] = pairs.get((r[0][0], r[1][0]), 0) + 1
    top = sorted(every, key=every.get)[-4:]
    for a in top:
        want = math.exp(every[a])
        assert abs(first.get(a, 0) / n - want) < 4 * math.sqrt(want / n) + 1e-3
    for a, b in itertools.permutations(top, 2):
        want = math.exp(every[a]) * math.exp(every[b]) / (1 - math.exp(every[a]))
        assert abs(pairs.get((a, b), 0) / n - want) < 4 * math.sqrt(want / n) + 1e-3


def test_inclusion_scores_weigh_without_bias():
    text = "to be"
    every = all_paths(text)
    n = 4000
    total = np.mean([sum(math.exp(w) / q for _, w, q in rows) for rows in sample([text] * n, 2).values()])
    assert abs(total - 1) < 0.05
    length = sum(math.exp(w) * len(k) for k, w in every.items())
    got = np.mean([sum(math.exp(w) / q * len(k) for k, w, q in rows) for rows in sample([text] * n, 2).values()])
    assert abs(got - length) < 0.05 * length


def test_text_comes_back():
    texts = ["", " ", "   lead", "trail  ", "a\n\nb\tc", "é😀漢字 x" + p.SPACE + "y", "x" * 3000, "\r\n", "Straße " * 50, "​\x00"]
    for d, rows in sample(texts, 3).items():
        for ids, _, _ in rows:
            assert spell(ids) == texts[d] if texts[d] else ids == ()


def test_samples_do_not_hang_on_the_batch(monkeypatch):
    texts = ["one two three", "four\nfive", "six seven eight nine", ""]
    whole = sample(texts, 2)
    for i, t in enumerate(texts):
        assert sample([t], 2, [i])[0] == whole[i]
    monkeypatch.setattr(p, "KEPT_EDGES", 20)
    assert sample(texts, 2) == whole


def test_a_slice_looks_up_each_different_unit_once(monkeypatch):
    asked, of = [], p.Lattices.of
    monkeypatch.setattr(p.Lattices, "of", lambda self, units: asked.append(len(units)) or of(self, units))
    assert len(sample(["of the\nof  the of the"] * 100, 2)) == 100
    assert asked == [5]  # with spaces before them: of, the (twice, after one space and two); without: the line end, of


def test_units_of_odd_texts():
    draw = random.Random(7)
    signs = [" ", "  ", "\n", "\t", "a", "bc", "é", "漢", "😀", p.SPACE, "\x00"]
    texts = ["", " ", "\n", p.SPACE, "", "\n a", " \n"] + ["".join(draw.choices(signs, k=draw.randrange(12))) for _ in range(500)] + [""]
    units, which, doc = p.units_of(pa.array(["before", *texts, "behind"]).slice(1, len(texts)))
    plain = [(i, u) for i, t in enumerate(texts) if t for u in re.findall(" +[^ \n]*|\n|[^ \n]+", " " + t)]
    names = [u.decode() for u in units.to_pylist()]
    assert [(i, names[w]) for i, w in zip(doc.tolist(), which.tolist(), strict=True)] == plain
    assert len(names) == len(set(names))
    for none in ([], ["", ""]):
        assert [len(x) for x in p.units_of(pa.array(none, pa.string()))] == [0, 0, 0]


def test_rows_nulls_ties_and_extra_columns(spark):
    schema = "doc_id long, text string, ids string, sample string"
    rows = [(1, "some text", "x", "y"), (1, "some text", "x", "y"), (None, "null id", "x", "y"), (4, None, "x", "y"), (5, "", "x", "y")]
    docs = spark.createDataFrame(rows, schema)
    out = p.encode_samples(docs)
    back = p.decode_ids(out).collect()
    assert sorted((r.doc_id, r.sample, r.text) for r in back if r.doc_id) == [(1, 0, "some text"), (1, 0, "some text"), (1, 1, "some text"), (1, 1, "some text"), (4, 0, ""), (5, 0, "")]
    assert [r.text for r in back if r.doc_id is None] == ["null id"] * 2
    assert p.encode_samples(docs.limit(0)).collect() == []
    assert sorted(map(str, out.collect())) == sorted(map(str, p.encode_samples(docs).collect()))


def test_repetitions_have_draws_of_their_own(spark):
    docs = spark.createDataFrame([(1, "some words that can be cut in many ways"), (1, "some words that can be cut in many ways"), (2, "once"), (None, None), (None, None)], "doc_id long, text string")
    got = p.encode_repeated(docs, samples=2).collect()
    ids = {(r.doc_id, r.repetition, r.sample): tuple(r.ids) for r in got}
    assert len(ids) == len(got) and {k[:2] for k in ids} == {(1, 0), (1, 1), (2, 0), (None, 0), (None, 1)}
    assert ids[1, 0, 0] != ids[1, 1, 0] and ids[1, 0, 0] != ids[1, 0, 1]
    assert {r.text for r in p.decode_ids(p.encode_repeated(docs)).where("doc_id = 1").collect()} == {docs.first().text}
    assert p.encode_repeated(docs.limit(0)).collect() == []

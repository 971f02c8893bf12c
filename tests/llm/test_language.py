import random
import zlib

import numpy as np

from folioflow.llm import language as lg

SCHEMA = "doc_id long, text string, lang string, score string"
SOUNDS = {"aa": ("ka", "lo", "mi", "tu"), "bb": ("schn", "eif", "orst", "ück"), "cc": ("qua", "ción", "ella", "ndo"), "dd": ("wyn", "ddl", "grw", "ych"), "ee": ("над", "ово", "при", "сть")}


def text(lang, rng, words=20):
    return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(words))


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, text(lang, rng, rng.choice([3, 20, 60])), lang) for i, lang in enumerate(rng.choices(langs, k=n))]


def run(spark, data, **options):
    got = lg.identify(spark.createDataFrame([(*r, "x") for r in data], SCHEMA), **options)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    return got.collect()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows_of_some_languages(spark):
    for langs in (["aa", "bb"], list(SOUNDS)):
        data = rows(300, langs)
        got = {r.doc_id: r for r in run(spark, data)}
        wrong = [i for i, _, lang in data if got[i].lang_pred != lang]
        assert not wrong and all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i, _, _ in data)


def test_many_languages_have_words_far_apart():
    for n in (2, 3, 4, 5, 6, 9, 40):
        words = lg.code(n).astype(int)
        apart = (words.shape[1] - words @ words.T) // 2
        assert len({tuple(w) for w in words}) == n and (np.abs(words.sum(0)) < n).all()
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n < 4 else 4)
    assert lg.code(1).shape == (1, 0) and lg.code(4).shape == (4, 7)


def test_a_wrong_bit_is_mended():
    words = lg.code(5)
    model = lg.Model(list("abcde"), words, None, np.ones(words.shape[1]))
    for k in range(5):
        for b in range(words.shape[1]):
            said = words[k] * 5.0
            said[b] *= -1
            assert model.chances(said).argmax() == k


def test_odd_rows(spark):
    rng = random.Random(3)
    data = rows(120, ["aa", "bb"]) + [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, "Ω", None), (None, text("aa", rng), "aa"), (904, text("bb", rng, 30_000), None), (905, "kalo", None), (905, "kalo", None)]
    got = run(spark, data)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data)
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) and by[i].second is None for i in (900, 901, 902))
    assert by[903].ambiguous and by[903].lang_pred in ("aa", "bb") and by[None].lang_pred == "aa" and not by[None].held_out
    assert by[904].lang_pred == "bb" and by[905].lang_pred == "aa"


def test_labels_of_held_out_rows_say_nothing(spark):
    data = rows(200, ["aa", "bb"])
    lies = [(i, t, ("zz" if held(i) else lang)) for i, t, lang in data]
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, run(spark, data))) == sorted(map(key, run(spark, lies)))


def test_few_languages_or_none(spark):
    assert {(r.lang_pred, r.score, r.second) for r in run(spark, rows(20, ["aa"]))} == {("aa", 1.0, None)}
    assert {(r.lang_pred, r.score) for r in run(spark, [(i, t, None) for i, t, _ in rows(20, ["aa"])])} == {("und", 0.0)}
    assert run(spark, []) == []


def test_few_drawn_rows_do(spark):
    data = rows(400, list(SOUNDS), 5)
    assert sum(r.lang_pred != lang for r, (_, _, lang) in zip(sorted(run(spark, data, fitted=15), key=lambda r: r.doc_id), data)) <= 4


def test_parts_hold_every_ngram_once(monkeypatch):
    whole = [np.bincount(lg.buckets(p), minlength=1 << lg.LG_BUCKETS) for p in lg.parts("Some words, and Ünïcode " * 30)]
    assert len(whole) == 1
    monkeypatch.setattr(lg, "PART", 50)
    monkeypatch.setattr(lg, "ORDERS", (4,))
    cut = sum(np.bincount(lg.buckets(p), minlength=1 << lg.LG_BUCKETS) for p in lg.parts("Some words, and Ünïcode " * 30))
    monkeypatch.setattr(lg, "PART", 1 << 16)
    assert (cut == sum(np.bincount(lg.buckets(p), minlength=1 << lg.LG_BUCKETS) for p in lg.parts("Some words, and Ünïcode " * 30))).all()

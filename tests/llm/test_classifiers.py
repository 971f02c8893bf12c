import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import quality as ql
from folioflow.llm import toxicity as tx

DOCS = "doc_id long, text string, lang string, score double, hits string"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    n = label.sum()
    return (order[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def corpus(seed=0, n=1500):
    """Texts of made-up words; toxic ones carry insults or words of a made-up stem, junk ones repeat, shout or are full of signs."""
    rng = np.random.default_rng(seed)
    parts = ["ka", "lo", "mi", "ter", "sen", "du", "ran", "vos", "il", "ped"]
    word = lambda: "".join(rng.choice(parts, rng.integers(2, 4)))
    rows, toxic, good = [], {}, {}
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(20, 120)))]
        toxic[i], good[i] = int(rng.random() < 0.12), int(rng.random() > 0.15)
        if toxic[i]:
            for _ in range(3):
                bad = str(rng.choice(["idiot", "moron", "scum"])) if i % 2 else "grzut" + str(rng.choice(parts)) + str(rng.choice(parts))
                words.insert(int(rng.integers(len(words))), bad)
        text = " ".join(words)
        if not good[i]:
            text = [" ".join(w + "%%%" for w in words), " ".join(w.upper() + "!!" for w in words), text + " " + " ".join(w for w in words[:8] for _ in range(8))][i % 3]
        rows.append((i, text, "en", 0.5, "x"))
    return rows, toxic, good


def test_toxicity_on_rows_it_has_not_seen(spark):
    rows, toxic, _ = corpus()
    docs = spark.createDataFrame(rows + [(5000, None, "en", 0.0, "x"), (5001, "", "en", 0.0, "x"), (None, "you grzutkalo grzutmimi idiot", "en", 0.0, "x"), (5002, "kalo", "en", 0.0, "x"), (5002, "kalo", "en", 0.0, "x")], DOCS)
    labels = spark.createDataFrame([*toxic.items(), (7, toxic[7]), (None, 1), (8, None)], "doc_id long, toxic int")
    got = tx.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in toxic if by[i].held_out]
    label = np.array([toxic[i] == 1 for i in held])
    assert len(held) > 200 and auc(np.array([by[i].score for i in held]), label) > 0.98
    assert by[5000].score == by[5001].score == by[5002].score and by[None].predicted == 1 and by[5000].predicted == 0
    clean = tx.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot and moron", "en", 0.0, "x"), (2, "kind words", "en", 0.0, "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in tx.score_toxicity(docs, none).collect()}
    assert got[1] > got[2]
    assert tx.score_toxicity(docs.limit(0), none).collect() == []


def test_every_stem_that_passes_the_chance_test_votes(spark):
    # eighty insults of one language, each in 30 toxic rows, fill the front ranks; two of a rarer language come last, in 12 rows each
    common = [f"zq{chr(97 + i // 10)}{chr(97 + i % 10)}{chr(97 + (7 * i) % 26)}x" for i in range(80)]
    rare = ["wñarru", "wçollo"]
    sets = [(w, 30) for w in common] + [(w, 12) for w in rare]
    rows = [(f"kalo miter {w} sendu", 1) for w, n in sets for _ in range(n)]
    # 250 stems that are no voters, as clean rows carry them too, but features
    rows += [(f"kalo miter {w} vosil", int(j < 3)) for i in range(250) for w in [f"ü{chr(97 + i // 26)}{chr(97 + i % 26)}"] for j in range(5)]
    rows += [("kalo miter sendu vosil", 0)] * 25_000
    chosen = tx.induce(spark.createDataFrame([(*r, tx.UNIT) for r in rows], "text string, toxic int, weight long"))
    assert {w[:4] for w in common + rare} <= set(chosen.voters)
    assert {w + "$" for w in tx.LEXICON} <= set(chosen.voters) and len(set(chosen.voters)) == len(chosen.voters) == len(chosen.toxic) == len(chosen.clean)
    assert len(chosen.extra) >= 250 and not set(chosen.extra) & set(chosen.voters)
    share = chosen.toxic / chosen.clean
    assert share[chosen.voters.index("wñar")] > 20


def test_texts_of_the_rarest_language_are_found(spark):
    common = [f"zq{chr(97 + i // 10)}{chr(97 + i % 10)}{chr(97 + (7 * i) % 26)}x" for i in range(80)]
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "sen", "du"], 3)) for _ in range(400)]
    said = [w for w in common for _ in range(25)] + ["wñarru"] * 20 + [None] * 12_000
    texts = [" ".join([*rng.choice(words, 6), *([w] if w else [])]) for w in said]
    docs = spark.createDataFrame([(i, x, "en", 0.0, "x") for i, x in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(w is not None)) for i, w in enumerate(said)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.score_toxicity(docs, labels).collect()}
    last = [i for i, w in enumerate(said) if w == "wñarru"]
    assert any(got[i].held_out for i in last) and all(got[i].predicted == 1 for i in last)
    assert sum(r.predicted for i, r in got.items() if said[i] is None) < 20


def test_families_weigh_and_no_row_is_dropped(spark):
    rows = [(f"one two three four copy", 1)] * 5 + [("one two three four copy", 0), ("quite another text here", 1)]
    got = tx.weighed(spark.createDataFrame(rows, "text string, toxic int")).collect()
    assert sorted((r.toxic, r.weight) for r in got) == [(0, tx.UNIT)] + [(1, tx.UNIT // 5)] * 5 + [(1, tx.UNIT)]
    # texts whose 32-bit hashes would meet by chance keep families of their own
    texts = [f"{i:x} text number {i}" for i in range(150_000)]
    assert len({tx.family(t) for t in texts}) == len(texts)


def test_hits_against_plain_counts():
    stems = ["kalo", "kalomi$", "3kalo", "3mite", "ter$", "3ter$", "kalomit"]
    index, lengths = tx._index(stems)
    rng = np.random.default_rng(4)
    for _ in range(200):
        words = [str(w) for w in rng.choice(["kalo", "kalomi", "kalomiter", "ter", "miter", "Miteren", "x"], rng.integers(0, 9))]

        def times(stem, words=words):
            return sum(w.lower() == stem[:-1] if stem[-1] == "$" else w.lower().startswith(stem) for w in words)

        want = [i for i, s in enumerate(stems) if times(s.removeprefix("3")) >= (3 if s[0] == "3" else 1)]
        assert tx.hits_of(" ".join(words), index, lengths) == want


def test_a_stem_that_toxic_texts_repeat_votes(spark):
    rows = [(f"kalo zqua{i % 9}x miter zquab zquac{'' if i % 2 else ' zquad'}", 1, tx.UNIT) for i in range(30)]
    rows += [("kalo zquab miter", 0, tx.UNIT)] * 40 + [("kalo miter sendu vosil", 0, tx.UNIT)] * 3000
    chosen = tx.induce(spark.createDataFrame(rows, "text string, toxic int, weight long"))
    assert "3zqua" in chosen.voters and "zqua" not in chosen.voters


def naive_posterior(votes, share, toxic, clean):
    if not votes:
        return 0.02 * share
    a, b = share, 1 - share
    for j in votes:
        a, b = a * toxic[j], b * clean[j]
    return a / (a + b)


def test_label_model_against_plain_expectation_maximisation(spark):
    rng = np.random.default_rng(8)
    rows = [([j for j in range(5) if rng.random() < (0.4 if i % 9 == 0 else 0.03)], int(rng.integers(1, 4))) for i in range(600)]
    known = tx.Voters(list("abcde"), [], 0.12, np.full(5, 0.3), np.full(5, 0.02), 40)
    model = tx.label_model(spark.createDataFrame(rows, "votes array<int>, n long"), known, rounds=3)
    toxic, clean = known.toxic.copy(), known.clean.copy()
    for _ in range(3):
        post = [naive_posterior(v, 0.12, toxic, clean) for v, _ in rows]
        p, n = sum(q * w for q, (_, w) in zip(post, rows, strict=True)), sum(w for _, w in rows)
        for j in range(5):
            pj = sum(q * w for q, (v, w) in zip(post, rows, strict=True) if j in v)
            nj = sum(w for v, w in rows if j in v)
            new_t = (pj + (5 + 40 * 0.12) * known.toxic[j]) / (p + 5 + 40 * 0.12)
            new_c = (nj - pj + (5 + 40 * 0.88) * known.clean[j]) / (n - p + 5 + 40 * 0.88)
            toxic[j], clean[j] = min(0.99, new_t), min(0.5, new_c)
    assert np.allclose(model.toxic, toxic, atol=1e-6) and np.allclose(model.clean, clean, atol=1e-6)


def test_label_model_finds_accuracies_and_correlations(spark):
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.1
    rates = [(0.6, 0.02), (0.5, 0.01), (0.3, 0.05)]
    votes = [(rng.random(20000) < np.where(y, a, b)) for a, b in rates]
    votes.append(votes[0])  # one voter repeats another
    rows = [([j for j in range(4) if votes[j][i]], 1) for i in range(20000)]
    known = tx.Voters(["a", "b", "c", "d"], [], 0.1, np.full(4, 0.4), np.full(4, 0.03), 10)
    model = tx.label_model(spark.createDataFrame(rows, "votes array<int>, n long"), known)
    assert model.correlation[0, 3] > 0.5 and abs(model.correlation[1, 2]) < 0.4
    assert model.toxic[0] > model.toxic[2] and all(model.clean < 0.1)
    assert model.weights[3] < 0.75 * model.weights[0]


def test_quality_on_rows_it_has_not_seen(spark):
    rows, _, good = corpus(1)
    docs = spark.createDataFrame(rows + [(5000, None, "en", 0.0, "x"), (5001, "", "en", 0.0, "x"), (None, rows[0][1], "en", 0.0, "x"), (5002, "ka lo " * 40000, "en", 0.0, "x")], DOCS)
    labels = spark.createDataFrame([*good.items(), (None, 1), (3, good[3])], "doc_id long, quality int")
    got = ql.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in good if by[i].held_out]
    assert auc(np.array([by[i].score for i in held]), np.array([good[i] == 1 for i in held])) > 0.97
    assert by[5000].score == by[5001].score and abs(by[None].score - by[0].score) < 1e-6
    assert ql.score_quality(docs.limit(0), labels).collect() == []
    one_class = ql.score_quality(docs.limit(3), labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1


def test_chunks_cover_the_document_and_grouping_changes_nothing():
    rng = np.random.default_rng(2)
    net = ql.Network(rng.normal(size=(ql.WIDTH, 256, ql.FILTERS)).astype(np.float32), rng.normal(size=(len(ql.LAGS), ql.FILTERS)).astype(np.float32), np.zeros(ql.FILTERS, np.float32), rng.normal(size=2 * ql.FILTERS).astype(np.float32) / 50, 0.1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 63, 511, 512, 513, 5000, 300_000)]
    for t in texts:
        chunks = ql.chunks_of(np.frombuffer(t, np.uint8))
        step = ql.CHUNK - ql.OVERLAP
        assert b"".join(bytes(c[:step]) for c in chunks[:-1]) + bytes(chunks[-1]) == t + b"\0" * (len(chunks) * step + ql.OVERLAP - len(t))
    together = ql.score_texts(net, texts)
    alone = np.array([ql.probability(net, ql.pooled(net, np.frombuffer(t, np.uint8))[None])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(6)
    net = ql.Network(rng.normal(size=(ql.WIDTH, 256, ql.FILTERS)).astype(np.float32), rng.normal(size=(len(ql.LAGS), ql.FILTERS)).astype(np.float32), rng.normal(size=ql.FILTERS).astype(np.float32), rng.normal(size=2 * ql.FILTERS).astype(np.float32), 0.1)
    for text in (b"", b"abcabcabcabc" * 9, bytes(rng.integers(97, 101, 1100).astype(np.uint8))):
        best, mean, at, n = np.zeros(ql.FILTERS), np.zeros(ql.FILTERS), 0, 0
        while n == 0 or at + ql.OVERLAP < len(text):
            chunk = text[at : at + ql.CHUNK].ljust(ql.CHUNK, b"\0")
            top = np.zeros(ql.FILTERS)
            for p in range(0, ql.CHUNK - ql.WIDTH + 1, ql.STRIDE):
                z = net.bias.astype(float) + sum(net.values[k][chunk[p + k]].astype(float) for k in range(ql.WIDTH))
                for k, lag in enumerate(ql.LAGS.tolist()):
                    same = sum(q < ql.CHUNK and q >= lag and chunk[q] == chunk[q - lag] != 0 for q in range(p, p + 32))
                    z = z + same / 32 * net.repeats[k]
                top = np.maximum(top, z)
            best, mean, n, at = np.maximum(best, top), mean + top, n + 1, at + ql.CHUNK - ql.OVERLAP
        got = ql.pooled(net, np.frombuffer(text, np.uint8))
        assert np.allclose(got, np.concatenate([best, mean / n]), atol=1e-3)


def test_labelled_rows_that_repeat_stay_bounded(spark):
    rows, _, good = corpus(3, 40)
    docs = spark.createDataFrame([(1, f"kalo miter {i}", "en", 0.0, "x") for i in range(500)] + rows[2:], DOCS)
    labels = spark.createDataFrame([*good.items()], "doc_id long, quality int")
    seen = []
    train = ql.train
    try:
        ql.train = lambda texts, y: seen.append(len(texts)) or train(texts, y, epochs=1)
        ql.fit(docs, labels, fitted=20)
    finally:
        ql.train = train
    assert seen and seen[0] <= 20

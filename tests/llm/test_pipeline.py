from collections import Counter

import corpus_pipeline
from folioflow.llm import ngram_join as nj
from folioflow.llm import pieces, toxicity

from test_dedup_and_mix import plain_targets
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["toxicity", "exact_dedup", "ngram_join", "mix_sources", "sentencepiece"]

    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    clean = stage["toxicity"](spark, docs, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == rows.keys() - rejected and rejected

    once = stage["exact_dedup"](spark, clean, SF)
    last = {}
    for i in sorted(rows.keys() - rejected):
        last[rows[i].text] = i
    assert {r.doc_id for r in once.collect()} == set(last.values())

    apart = stage["ngram_join"](spark, once, SF)
    want = {c for _, c, _ in brute([(i, rows[i].text) for i in last.values()])}
    kept = {r.doc_id: r for r in apart.collect()}
    assert kept.keys() == want

    mix = stage["mix_sources"](spark, apart, SF)
    assert mix.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in kept.values():
        sizes[r.source] += len(r.text.split())
    copies = Counter(r.doc_id for r in mix.collect())
    for i, n in copies.items():
        assert n <= 2
        taken[rows[i].source] += n * len(rows[i].text.split())
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= max(len(r.text.split()) for r in kept.values() if r.source == s) / 2

    encoded = pieces.decode_ids(stage["sentencepiece"](spark, mix, SF)).collect()
    assert Counter(r.doc_id for r in encoded if r.sample == 0) == copies
    assert all(r.text == rows[r.doc_id].text for r in encoded)


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "a", 0, "z"), (1, None, "en", "a", 0, "z"), (None, "b c", None, None, 3, "z"), (4, "", "en", "a", 0, "z"), (5, "you idiot, moron and scum", "en", "a", 9, "z")], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 1, 4, 5}
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert out.columns == docs.columns


def test_threshold_and_words_of_the_near_stage():
    assert (nj.WORDS, nj.THRESHOLD) == (5, 0.8)

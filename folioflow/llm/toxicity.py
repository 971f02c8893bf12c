"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, materialize, read

#: Labelled rows that voters are induced from, and documents that the classifier is fitted to, at most.
LABELLED, FITTED = 20_000, 16_384
THRESHOLD = 0.3
#: Rows whose stems are held in Python at a time.
ROWS = 1024
#: P(toxic) of a document whose label says so.
SURE = 0.98
#: Shortest and longest beginning of a word that a pattern voter looks for.
SHORT, LONG = 4, 7
#: A stem that so many words of a text have is a voter of its own, named with this mark; no stem begins with a digit.
OFTEN, OFTEN_MARK = 3, "3"
#: Weight of a labelled row that has no near copy; divisible by every small number, so that shares of it are whole.
UNIT = 720_720

# A seed lexicon of common English insults; each word is a voter.
LEXICON = ("clown", "disgusting", "dumb", "fool", "freak", "garbage", "hate", "idiot", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless")

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def family(text: str) -> int:
    """The least 64-bit hash of a text's word triples: near copies mostly share it, other texts do not."""
    words = text.split()
    triples = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t in triples)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([family(t) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["text", "toxic", "family"])


def weighed(taught: DataFrame) -> DataFrame:
    """Labelled rows (text, toxic) with ``weight``: UNIT shared among the rows of a family and label, at least 1 each.

    Copies and near copies of a text so count once together, or chance words of a large family would pass for signs; every row keeps its say.
    """
    rows = materialize(taught.mapInArrow(_families, "text string, toxic int, family long"), "tox-families")
    large = materialize(rows.groupBy("family", "toxic").agg(F.count("*").alias("size")).where("size > 1"), "tox-large")
    large = F.broadcast(large) if large.count() <= LABELLED else large
    weight = F.greatest(F.lit(1), F.floor(F.lit(UNIT) / F.coalesce("size", F.lit(1)))).cast("long")
    return rows.join(large, ["family", "toxic"], "left").select("text", "toxic", weight.alias("weight"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows: what Python makes of a batch is let go before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        seen = (Counter(), Counter())
        for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
            times = Counter()
            for w, n in Counter(words_of(text)).items():
                times[w + "$"] += n  # the whole word
                for k in range(SHORT, min(LONG, len(w)) + 1):
                    times[w[:k]] += n
            count = seen[toxic]
            for stem, n in times.items():
                count[stem] += weight
                if n >= OFTEN:
                    count[OFTEN_MARK + stem] += weight
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["stem", "bad", "good"])


@dataclass
class Voters:
    """Stems that vote, stems that are features only (a trailing $ marks a whole word, a leading OFTEN_MARK one that is there OFTEN), and what labelled rows say of them:
    the share of toxic rows, P(voter | toxic), P(voter | clean), and the number of labelled rows behind that."""

    voters: list[str]
    extra: list[str]
    share: float
    toxic: np.ndarray
    clean: np.ndarray
    rows: int


def induce(labelled: DataFrame) -> Voters:
    """Chooses voters from rows of text, toxic and weight (in UNITs).

    A stem is a word or a word's beginning; what counts is that a text has it, or that it has it OFTEN. It votes if toxic rows carry it so much more often than their share that, over
    all stems seen, chance brings one about with 0.05 at most, whatever the number of rows; of nested ones the shortest that is nearly as pure stays.
    However many pass, all vote, and the words of the seed lexicon that none of them covers vote beside them. Other stems
    that toxic rows carry over four times as often as their share are features. Stems are weighed in Spark.
    """
    bad_rows, rows = labelled.agg(F.sum(F.col("toxic") * F.col("weight")) / UNIT, F.sum("weight") / UNIT).first()
    if not bad_rows or bad_rows == rows:
        return Voters([w + "$" for w in LEXICON], [], 0.05, np.full(len(LEXICON), 0.1), np.full(len(LEXICON), 0.001), 0)
    share = bad_rows / rows
    counts = labelled.mapInArrow(_count_stems, "stem string, bad long, good long").groupBy("stem").agg((F.sum("bad") / UNIT).alias("bad"), (F.sum("good") / UNIT).alias("good"))
    seeds = [w + "$" for w in LEXICON]
    counts = materialize(counts.where((F.col("bad") >= 3) | F.col("stem").isin(seeds)), "stem-counts")
    weighed = counts.where("bad >= 3")
    n_stems = max(1, weighed.count())
    p, n = F.col("p"), F.col("bad") + F.col("good")
    # Chernoff bound of the binomial tail
    tail = n * (p * F.log(p / share) + F.when(p < 1 - 1e-9, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    scored = weighed.withColumn("p", F.col("bad") / n).where(p > min(0.9, 4 * share)).withColumn("surplus", tail - math.log(n_stems))
    scored = materialize(scored.withColumn("votes", (F.col("surplus") > math.log(20)) & (p >= 0.85)), "stem-scores")
    often = F.startswith("stem", F.lit(OFTEN_MARK))
    body = F.rtrim(F.when(often, F.expr(f"substring(stem, {len(OFTEN_MARK) + 1})")).otherwise(F.col("stem")), F.lit("$"))
    longest = F.least(F.lit(LONG), F.length(body) - F.when(F.endswith("stem", F.lit("$")), 0).otherwise(1))
    mark = F.when(often, OFTEN_MARK).otherwise("")
    shorter = F.when(longest >= SHORT, F.transform(F.sequence(F.lit(SHORT), longest), lambda k: F.concat(mark, F.substring(body, F.lit(1), k))))
    inner = scored.select("stem", "p", "votes", F.explode(shorter).alias("start"))
    outer = scored.select(F.col("stem").alias("start"), F.col("p").alias("p_start"), F.col("votes").alias("start_votes"))
    nested = inner.join(outer, "start").where("p_start >= 0.95 * p AND (start_votes OR NOT votes)").select("stem").distinct()
    found = scored.join(nested, "stem", "left_anti").orderBy(F.desc("surplus"), "stem").select("stem", "votes", "bad", "good").collect()
    kept = [r.stem for r in found if r.votes]
    covered = tuple(s for s in kept if s[-1] != "$" and s[0] != OFTEN_MARK)
    voters = kept + [w for w in seeds if w not in kept and not w.startswith(covered)]
    known = set(voters)
    extra = [r.stem for r in found if r.stem not in known]
    of = {r.stem: r for r in (*counts.where(F.col("stem").isin(seeds)).select("stem", "bad", "good").collect(), *found)}
    toxic = np.array([((of[v].bad if v in of else 0) + 0.5) / (bad_rows + 5) for v in voters])
    clean = np.array([((of[v].good if v in of else 0) + 0.05) / (rows - bad_rows + 5) for v in voters])
    return Voters(voters, extra, share, toxic, clean, rows)


def _index(stems: list[str]) -> tuple[dict[str, tuple[int, int]], list[int]]:
    """For each stem its numbers, as one that is there and as one that is there OFTEN (-1: not looked for), and the lengths of beginnings."""
    at = {s: i for i, s in enumerate(stems)}
    plain = {s.removeprefix(OFTEN_MARK) for s in stems}
    return {s: (at.get(s, -1), at.get(OFTEN_MARK + s, -1)) for s in plain}, sorted({len(s) for s in plain if s[-1] != "$"})


def hits_of(text: str, index: dict[str, tuple[int, int]], lengths: list[int]) -> list[int]:
    """The numbers of the stems that a text has."""
    times: dict[tuple[int, int], int] = {}
    for w, n in Counter(words_of(text)).items():
        if (at := index.get(w + "$")) is not None:
            times[at] = times.get(at, 0) + n
        for k in lengths:
            if k <= len(w) and (at := index.get(w[:k])) is not None:
                times[at] = times.get(at, 0) + n
    found = [once for once, _ in times] + [often for (_, often), n in times.items() if n >= OFTEN]
    return sorted(i for i in found if i >= 0)


def _match(stems: list[str], kept: list[str]):
    index, lengths = _index(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hits = [hits_of(text.as_py() or "", index, lengths) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hits, pa.list_(pa.int32()))], names=[*kept, "hits"])

    return run


def linear(hits: Column, bias: float, weights: np.ndarray) -> Column:
    """1 / (1 + exp(-(bias + sum of weights of hits)))"""
    w = F.lit(np.asarray(weights, float))  # one literal, however many there are
    total = F.aggregate(hits, F.lit(float(bias)), lambda acc, i: acc + F.get(w, i))
    return 1 / (1 + F.exp(-total))


def posterior(votes: Column, bias: float, weights: np.ndarray) -> Column:
    """P(toxic | votes); a text without votes is toxic a fiftieth as often as texts are."""
    return F.when(F.size(votes) > 0, linear(votes, bias, weights)).otherwise(F.lit(0.02 / (1 + math.exp(-bias))))


@dataclass
class LabelModel:
    """What the voters are worth: P(vote | toxic), P(vote | clean), their correlation among toxic rows, and the posterior's terms."""

    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    bias: float
    weights: np.ndarray

    def posterior(self, votes: Column) -> Column:
        return posterior(votes, self.bias, self.weights)


def label_model(votes: DataFrame, known: Voters, rounds: int = 4) -> LabelModel:
    """Fits the generative model by expectation maximisation to ``votes`` (votes: array of voter numbers, n: texts that cast them).

    A text is toxic with probability ``share``; voter j then votes with probability toxic[j], else clean[j]. A voter that keeps
    quiet says nothing, but a text for which nobody votes is taken for clean. It starts from what
    labelled rows say, which counts as that many rows in each round, so that a large family of near copies cannot take the
    place of toxicity. A round is one aggregation that returns two sums per voter. Voters whose votes go together among toxic rows more than the model says
    share their evidence: a voter's weight is divided by one plus its positive correlations with stronger voters.
    """
    n_voters, share = len(known.voters), min(0.5, max(0.005, known.share))
    toxic, clean = known.toxic.copy(), known.clean.copy()
    held_bad, held_good = 5 + known.rows * share, 5 + known.rows * (1 - share)

    def terms() -> tuple[float, np.ndarray]:
        return math.log(share / (1 - share)), np.log(toxic / clean)

    for _ in range(rounds):
        post = votes.select("votes", "n", (F.col("n") * posterior(F.col("votes"), *terms())).alias("p"))
        sums = post.select(F.explode(F.concat("votes", F.array(F.lit(-1)))).alias("j"), "n", "p").groupBy("j").agg(F.sum("p"), F.sum("n")).collect()
        got = {r[0]: (r[1], r[2]) for r in sums}
        p, n = got.get(-1, (0.0, 0))
        if not n:
            break
        for j in range(n_voters):
            pj, nj = got.get(j, (0.0, 0))
            toxic[j] = min(0.99, (pj + held_bad * known.toxic[j]) / (p + held_bad))
            clean[j] = min(0.5, (nj - pj + held_good * known.clean[j]) / (n - p + held_good))
    bias, weights = terms()
    both = F.explode(F.flatten(F.transform("votes", lambda i: F.transform(F.filter("votes", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    post = votes.select("votes", (F.col("n") * posterior(F.col("votes"), bias, weights)).alias("p"))
    p = post.agg(F.sum("p")).first()[0] or 0.0
    correlation = np.zeros((n_voters, n_voters))
    for r in post.select(both.alias("b"), "p").groupBy("b.i", "b.j").agg(F.sum("p").alias("p")).collect():
        spread = math.sqrt(toxic[r.i] * (1 - toxic[r.i]) * toxic[r.j] * (1 - toxic[r.j]))
        correlation[r.i, r.j] = correlation[r.j, r.i] = max(-1.0, min(1.0, (r.p / max(p, 1e-9) - toxic[r.i] * toxic[r.j]) / spread))
    strength = toxic - 1e-9 * np.arange(n_voters)
    stronger = strength[None, :] > strength[:, None]
    shared = 1 + np.where(stronger & (correlation > 0.1), correlation, 0).sum(1)
    return LabelModel(toxic, clean, correlation, bias, np.where(weights > 0, weights / shared, weights))


def fit_linear(hits: list[list[int]], target: np.ndarray, n_features: int, rounds: int = 300, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Logistic regression of soft labels on the presence of features, by accelerated gradient descent from log-odds."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.fromiter((i for h in hits for i in h), np.int64, len(row))  # only what is present is kept, so features may be many
    w = np.zeros(n_features + 1)
    speed = np.zeros_like(w)
    scale = 1 / np.sqrt(np.append(np.bincount(col, minlength=n_features), len(hits)) / len(hits) + 1e-4)  # rare features move as fast as common ones
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        off = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[col], len(hits)) + ahead[-1], -30, 30))) - target
        grad = np.append(np.bincount(col, off[row], n_features), off.sum()) / len(hits) + ridge * np.append(w[:-1], 0)
        speed = 0.9 * speed - 0.2 * scale**2 * grad / 4
        w += speed
    return float(w[-1]), w[:-1]


@dataclass
class Classifier:
    """A linear classifier on the stems that a text has."""

    stems: list[str]
    bias: float
    weights: np.ndarray

    def of_hits(self, hits: Column) -> Column:
        return linear(hits, self.bias, self.weights)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], labelled: int = LABELLED, fitted: int = FITTED) -> tuple[Classifier, DataFrame]:
    """The classifier, and what it saw of each row of ``docs``: its columns ``keep`` (text, and others in row) and hits (numbers of stems)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "tox-known")
    taught = docs.select("doc_id", empty_if_null("text").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    chosen = induce(materialize(weighed(taught), "tox-taught"))
    stems, n_voters = chosen.voters + chosen.extra, len(chosen.voters)
    hashed = docs.select("text", F.xxhash64(empty_if_null("text")).alias("h"), "doc_id", F.struct(*[F.col(f"`{c}`") for c in keep if c != "text"]).alias("row"))
    kept = ["h", "doc_id", "row", *[c for c in keep if c == "text"]]
    seen = hashed.mapInArrow(_match(stems, kept), ", ".join(f"{c} {hashed.schema[c].dataType.simpleString()}" for c in kept) + ", hits array<int>")
    seen = materialize(seen, "tox-hits")
    cast = F.filter("hits", lambda i: i < n_voters)
    votes = seen.groupBy("h", cast.alias("votes")).count().groupBy("votes").agg(F.count("*").alias("n"))
    model = label_model(materialize(votes, "tox-votes"), chosen)
    order = (F.xxhash64("hits", "doc_id"), "doc_id")
    sample = seen.withColumn("p", model.posterior(cast)).orderBy(*order).limit(fitted).select("hits", "p").collect()
    # a label is a voter that is nearly always right, where there is one
    said = seen.join(F.broadcast(known), "doc_id").withColumn("p", F.when(F.col("toxic") == 1, SURE).otherwise(1 - SURE))
    sample += said.orderBy(*order).limit(labelled).select("hits", "p").collect()
    if sample:
        bias, weights = fit_linear([r.hits for r in sample], np.array([r.p for r in sample]), len(stems))
    else:
        bias, weights = model.bias, np.append(model.weights, np.zeros(len(chosen.extra)))
    return Classifier(stems, bias, weights), seen.drop("h", "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, fitted: int = FITTED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    ``labels`` (doc_id, toxic) teach which stems may vote and are voters themselves, from at most ``labelled`` rows that are
    not held out, drawn by hash; a row labelled twice counts as toxic if one label says so. Votes of all documents fit the label
    model; the classifier is fitted to at most ``fitted`` documents and ``labelled`` labelled ones, drawn by hash. Null texts
    count as empty: they have no votes and get the score of a text without hits. Scores depend on the text alone. Without
    labels the seed lexicon votes alone.
    """
    model, seen = fit_toxicity(docs, labels, ["doc_id"], labelled, fitted)
    return seen.select("row.doc_id", held_out("row.doc_id").alias("held_out"), model.of_hits(F.col("hits")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that the classifier takes for toxic: those whose score reaches THRESHOLD.

    A row's score depends on its text alone, so repeated rows stay or go together and a null doc_id stays; null texts count as
    empty, and an empty text has the score of one without votes. An empty table stays empty. Columns keep their names and values, whatever they are called.
    """
    model, seen = fit_toxicity(docs, labels, docs.columns)
    return seen.where(model.of_hits(F.col("hits")) < THRESHOLD).select(*[F.col(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))

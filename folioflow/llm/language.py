"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the code a binary classifier over byte n-grams predicts the bit of a text: the log
odds of the text's n-grams between the languages whose bit is 1 and those whose bit is 0. Decoding takes the codeword with the
least loss against all predictions, weighted by how sure each classifier was of texts that it was fitted to, and flags texts
whose nearest codewords are about as near.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, forget, materialize, read

#: Labelled rows of a language that classifiers are fitted to, on average at most; drawn by hash, whole texts.
FITTED = 4_096
#: Lengths of n-grams, and the buckets that they are hashed to, as a power of two.
ORDERS, LG_BUCKETS = (1, 2, 3, 4), 17
#: Bits of a code beyond what tells all splits of a few languages apart.
BITS = 31
#: What a bucket has at least, spread over all, and how often a text counts for one bucket at most when it is learnt.
SMOOTH, TIMES = 0.5, 16
#: A text is ambiguous if the second language's chance is over so much of the first's.
NEAR = 0.25
#: Bytes that are looked at together; texts that are longer are summed up part by part.
PART = 1 << 16
UNKNOWN = "und"
#: ASCII letters in lower case and what is not ASCII; all else is a space.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def buckets(data: np.ndarray) -> np.ndarray:
    """The buckets of all n-grams of some bytes."""
    out = []
    x = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        x = (x[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        if n in ORDERS and len(x):
            mixed = (x ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            out.append((mixed * np.uint32(2246822519)) >> np.uint32(32 - LG_BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def parts(text: str) -> Iterator[np.ndarray]:
    """The bytes of a text as they are looked at, in parts that overlap so that each n-gram is in one of them (short ones may be in two)."""
    data = np.frombuffer(b" " + b" ".join(text.encode().translate(_BYTES).split()) + b" ", np.uint8).astype(np.uint32)
    step = PART - max(ORDERS) + 1
    for at in range(0, max(1, len(data) - max(ORDERS) + 1), step):
        yield data[at : at + PART]


def code(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """(n, bits) of -1 and 1: codewords of n languages. All splits in two of up to ``bits``; beyond, drawn columns, the best of some draws."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if 2 ** (n - 1) - 1 <= bits:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(bits, math.ceil(10 * math.log2(n)))
    for _ in range(50):
        drawn = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        drawn = np.where(np.abs(drawn.sum(0)) == n, -drawn * np.where(np.arange(n) == 0, -1, 1)[:, None], drawn).astype(np.int8)  # no column is all of one kind
        apart = (bits - drawn.astype(np.int32) @ drawn.T.astype(np.int32)) // 2
        nearest = int((apart + np.eye(n, dtype=np.int64) * bits).min())
        if nearest > far:
            best, far = drawn, nearest
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits) of -1, 1
    odds: np.ndarray  # (buckets, bits): log odds of a bit for each occurrence
    sure: np.ndarray  # (bits,): weights of the classifiers, 1 on average

    def margins(self, text: str) -> np.ndarray:
        """What each classifier says of a text: log odds that its bit is 1."""
        total = np.zeros(self.odds.shape[1])
        for data in parts(text):
            total += self.odds[buckets(data)].sum(0, dtype=np.float64)
        return total / len(ORDERS)

    def chances(self, margins: np.ndarray) -> np.ndarray:
        """By language: the softmax of the weighted losses, which are those of logistic regression."""
        loss = np.logaddexp(0, -self.code * margins[None, :]) @ self.sure
        away = np.exp(-(loss - loss.min()) / max(1.0, self.code.shape[1] / 2))
        return away / away.sum()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets by language of a task's rows."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            into = counts.setdefault(lang, np.zeros(1 << LG_BUCKETS, np.int64))
            for data in parts(text):
                which, n = np.unique(buckets(data), return_counts=True)
                into[which] += np.minimum(n, TIMES)
    for lang, n in counts.items():
        which = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(which)), pa.array(which.astype(np.int32)), pa.array(n[which])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, fitted: int = FITTED) -> Model:
    """Fits the classifiers to rows of ``docs`` (doc_id, text, lang) that are not held out and have a language and a letter.

    Of each language about ``fitted`` rows are drawn by hash, or all where there are fewer. Their n-grams are counted in Spark;
    the counts by language and bucket, and one row per language, reach the driver.
    """
    taught = docs.where(F.col("lang").isNotNull() & ~held_out() & F.rlike("text", F.lit(r"\p{L}")))
    sizes = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((1 << LG_BUCKETS, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, fitted / sizes[k]))]), F.col("lang"))
    drawn = taught.where(F.pmod(F.xxhash64(F.lit(12), "doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    drawn = materialize(drawn.select("lang", "text"), "lang-drawn")
    counts = np.zeros((len(langs), 1 << LG_BUCKETS))
    summed = drawn.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in summed.column("lang").to_pylist()], summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    words = code(len(langs))
    # a bucket that no text has says nothing: what is added is in proportion to the language's own size
    likely = (counts + SMOOTH * counts.sum(1, keepdims=True) / counts.sum(1).max()) / counts.sum(1, keepdims=True)
    odds = np.zeros((1 << LG_BUCKETS, words.shape[1]))
    for b in range(words.shape[1]):
        odds[:, b] = np.log(likely[words[:, b] > 0].mean(0)) - np.log(likely[words[:, b] < 0].mean(0))
    model = Model(langs, words, odds.astype(np.float32), np.ones(words.shape[1]))
    if words.shape[1]:
        model.sure = _sure(drawn, model)
    forget(drawn)
    return model


def _sure(drawn: DataFrame, model: Model) -> np.ndarray:
    """Weights of the classifiers: the log odds that they are right about the drawn rows, by language in equal shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
            right = [(lang, model.code[model.langs.index(lang)] * model.margins(text) > 0) for lang, text in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in right], pa.string()), pa.array([x.tolist() for _, x in right], pa.list_(pa.bool_()))], names=["lang", "right"])

    each = drawn.mapInArrow(run, "lang string, right array<boolean>").select("lang", F.posexplode("right").alias("bit", "right"))
    shares = each.groupBy("bit", "lang").agg(F.avg(F.col("right").cast("double")).alias("share")).groupBy("bit").agg(F.avg("share").alias("share")).collect()
    right = np.full(model.code.shape[1], 0.5)
    for r in shares:
        right[r.bit] = r.share
    sure = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.1)
    return sure / sure.mean()


def identify(docs: DataFrame, fitted: int = FITTED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang; others are ignored): doc_id, held_out, lang_pred, score (0 to 1), second, ambiguous.

    ``lang`` only fits the classifiers; predictions depend on the text alone, of which all is read, part by part if it is long.
    Null texts and those without a letter are ``und``, with score 0, and so is everything if no row has a language. ``second``
    is the next likely language, null if there is one alone. Equal chances go to the language that is first by name; repeated
    rows fare alike; null doc_ids stay and are taught from.
    """
    model = fit(docs, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, second, ambiguous = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if text is None or not model.langs:
                    order, chances = [], []
                else:
                    chances = model.chances(model.margins(text)) if len(model.langs) > 1 else np.ones(1)
                    order = np.argsort(-chances, kind="stable")
                best.append(model.langs[order[0]] if len(order) else UNKNOWN)
                score.append(float(chances[order[0]]) if len(order) else 0.0)
                second.append(model.langs[order[1]] if len(order) > 1 else None)
                ambiguous.append(bool(len(order) > 1 and chances[order[1]] > NEAR * chances[order[0]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(ambiguous, pa.bool_())], names=["doc_id", "lang_pred", "score", "second", "ambiguous"])

    lettered = docs.select("doc_id", F.when(F.rlike(empty_if_null("text"), F.lit(r"\p{L}")), F.col("text")).alias("text"))
    found = lettered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, second string, ambiguous boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))

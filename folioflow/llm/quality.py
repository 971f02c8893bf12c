"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that together cover all of it. Learned filters slide over each chunk; they
see the bytes, as learned values, and for each of some distances how many bytes around repeat the byte so far before. The
filters' responses are max-pooled per chunk and over the whole document, and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, read

#: Labelled rows that the network is fitted to, at most; of each the whole text.
FITTED = 4_096
#: Bytes of a chunk, of which OVERLAP are the last of the chunk before; filter width, stride, filters, and distances of repetition.
CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS = 512, 64, 8, 4, 16
LAGS = np.arange(2, 34)
#: Bytes of a document that are in memory as features at a time.
SLICE = 1 << 19
#: Chunks whose responses training holds at a time.
PART = 512


@dataclass
class Network:
    values: np.ndarray  # (WIDTH, 256, FILTERS): what each byte adds to each filter at each place
    repeats: np.ndarray  # (lags, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): weights of the largest and of the mean chunk response
    last: float


def chunks_of(data: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover ``data``, each beginning OVERLAP before the end of the one before; zeros fill the last."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def repetition(chunks: np.ndarray) -> np.ndarray:
    """(chunks, places, lags): the share of the 32 bytes from each place on that equal the byte ``lag`` before them."""
    n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
    out = np.zeros((n, places, len(LAGS)), np.float32)
    for k, lag in enumerate(LAGS):
        same = np.zeros((n, CHUNK + 32), np.uint8)
        same[:, lag:CHUNK] = (chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] != 0)
        fours = same.reshape(n, -1, 4).sum(2, dtype=np.uint8)
        runs = fours[:, :-7].copy()
        for o in range(1, 8):
            runs += fours[:, o : fours.shape[1] - 7 + o]
        out[:, :, k] = runs[:, :places]
    return out / 32


def responses(net: Network, chunks: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """(chunks, places, filters), before rectification."""
    places = (CHUNK - WIDTH) // STRIDE + 1
    z = repeats @ net.repeats
    z += net.bias
    for k in range(WIDTH):
        z += net.values[k][chunks[:, k : k + (places - 1) * STRIDE + 1 : STRIDE]]
    return z


def pooled(net: Network, data: np.ndarray) -> np.ndarray:
    """(2 * FILTERS,): each filter's largest response in the document and the mean over its chunks of the largest in each."""
    best, total, n = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
    chunks = chunks_of(data)
    per = SLICE // CHUNK
    for at in range(0, len(chunks), per):
        part = chunks[at : at + per]
        top = np.maximum(responses(net, part, repetition(part)).max(1), 0)
        best = np.maximum(best, top.max(0))
        total += top.sum(0)
        n += len(part)
    return np.concatenate([best, (total / n).astype(np.float32)])


def probability(net: Network, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ net.out + net.last, -30, 30)))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities; chunks of many texts are convolved together, those of a long one by parts."""
    x = np.zeros((len(texts), 2 * FILTERS), np.float32)
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and (not group or size + len(texts[at + len(group)]) <= SLICE // 2):
            size += max(CHUNK, len(texts[at + len(group)]))
            group.append(np.frombuffer(texts[at + len(group)], np.uint8))
        if len(group) == 1:
            x[at] = pooled(net, group[0])
        else:
            parts = [chunks_of(g) for g in group]
            chunks = np.concatenate(parts)
            starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
            top = np.maximum(responses(net, chunks, repetition(chunks)).max(1), 0)
            x[at : at + len(group), :FILTERS] = np.maximum.reduceat(top, starts)
            x[at : at + len(group), FILTERS:] = np.add.reduceat(top, starts) / np.array([len(p) for p in parts])[:, None]
        at += len(group)
    return probability(net, x)


def strongest(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By chunk and filter: the place of the largest response, that response, and the repetition there. Works through the chunks by parts."""
    place, top = np.zeros((len(chunks), FILTERS), np.int64), np.zeros((len(chunks), FILTERS), np.float32)
    there = np.zeros((len(chunks), FILTERS, len(LAGS)), np.float32)
    for at in range(0, len(chunks), PART):
        part = chunks[at : at + PART]
        rep = repetition(part)
        z = responses(net, part, rep)
        where = z.argmax(1)
        rows = np.arange(len(part))[:, None]
        place[at : at + PART], top[at : at + PART], there[at : at + PART] = where, z[rows, where, np.arange(FILTERS)[None, :]], rep[rows, where]
    return place, np.maximum(top, 0), there


def train(texts: list[bytes], good: np.ndarray, epochs: int = 14, seed: int = 5) -> Network:
    """Fits the network to texts and labels (1: good) by Adam, classes in equal weight at first, then as they are.

    A step sees all chunks of some texts, as scoring does; the gradient runs through the largest place of the largest chunk,
    and through each chunk's largest place for the mean.
    """
    rng = np.random.default_rng(seed)
    w = {
        "values": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        "repeats": rng.normal(0, 0.3, (len(LAGS), FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
        "last": np.array(np.log((good.mean() + 0.01) / (1.01 - good.mean())), np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, share = 0, np.clip(good.mean(), 0.02, 0.98)
    cols = np.arange(FILTERS)[None, :]
    for epoch in range(epochs):
        even = epoch < epochs - 4
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            picks = [chunks_of(np.frombuffer(texts[i], np.uint8)) for i in batch]
            chunks = np.concatenate(picks)
            starts = np.cumsum([0, *[len(p) for p in picks[:-1]]])
            owner = np.repeat(np.arange(len(picks)), [len(p) for p in picks])
            sizes = np.array([len(p) for p in picks])[:, None]
            net = Network(**w)
            place, top, there = strongest(net, chunks)
            best = np.maximum.reduceat(top, starts)
            x = np.concatenate([best, np.add.reduceat(top, starts) / sizes], 1)
            y = good[batch].astype(np.float32)
            weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) if even else np.ones(len(y))
            d = ((probability(net, x) - y) * weight / len(y)).astype(np.float32)
            dx = d[:, None] * w["out"][None, :]
            dtop = dx[owner, FILTERS:] / sizes[owner] + dx[owner, :FILTERS] * (top == best[owner])
            dtop *= top > 0
            grad = {"out": x.T @ d + 1e-4 * w["out"], "last": d.sum(), "bias": dtop.sum(0)}
            grad["repeats"] = np.einsum("nfl,nf->lf", there, dtop) + 1e-5 * w["repeats"]
            grad["values"] = np.zeros_like(w["values"])
            rows = np.arange(len(chunks))[:, None]
            for k in range(WIDTH):
                np.add.at(grad["values"][k], (chunks[rows, place * STRIDE + k], np.broadcast_to(cols, place.shape)), dtop)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * np.square(g)
                w[k] = (w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(w["values"], w["repeats"], w["bias"], w["out"], float(w["last"]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Network:
    """Trains on at most ``fitted`` labelled rows that are not held out, drawn by hash, half of either class where there are so many.

    Whole texts are trained on, in the driver: its memory goes with ``fitted``. A row labelled twice counts as good only if both
    labels say so. Of rows that agree in doc_id one is taught.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    halves = [known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted // 2) for g in (0, 1)]
    n_good, n = known.agg(F.sum("good"), F.count("*")).first()
    rows = docs.select("doc_id", empty_if_null("text").alias("text")).join(F.broadcast(halves[0].unionByName(halves[1])), "doc_id")
    once = rows.groupBy("doc_id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    taught = once.orderBy(F.xxhash64("doc_id"), "doc_id").select(F.encode("text", "UTF-8").alias("b"), "good").toArrow()
    good = np.array(taught.column("good").to_pylist(), np.float32)
    if not len(good) or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros((len(LAGS), FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    net = train([bytes(b) for b in taught.column("b").to_pylist()], good)
    # the classes were drawn in other shares than they have: move the odds back
    was, now = good.mean(), min(0.98, max(0.02, n_good / n))
    net.last += float(np.log(now / (1 - now)) - np.log(was / (1 - was)))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    Labels (doc_id, quality; 1: good) only train the network. Whole texts are scored, chunk by chunk; scores depend on the text
    alone. Null texts count as empty, and an empty text is a chunk of zeros. Without labels of both classes every score is
    their share.
    """
    net = fit(docs, labels, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(net, batch.column("text").cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"))

"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification.

Documents with the same set of shingles are one node. Nodes that agree in a band of their MinHash signature are candidates;
within a bucket signatures are compared a few values at a time, and a pair is dropped once the posterior probability that its
Jaccard similarity reaches the threshold is below a tolerance. What is left hangs together in small clusters, and inside a
cluster all pairs are pruned likewise and verified on whole shingle sets. Groups of any size are compared block by block;
what leaves a task is a number of links and one edge per node, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, forget, id_key, materialize, read
from folioflow.llm.components import components
from folioflow.llm.groups import block_pairs, fixed_binary, lists, map_groups

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 5 values: a pair of similarity 0.8 meets in none of them with a chance of 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
TOLERANCE, STEP = 1e-6, 32
BUCKET_BLOCK, CLUSTER_BLOCK = 256, 128
#: Groups of more than a block are sent to all executors up to this many, and joined by a shuffle beyond.
BROADCAST_GROUPS = 100_000
SLICE = 1 << 20  # bytes of text hashed at a time
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, p, _U)])) for p in (_P, _PINV)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 ``data`` that holds texts ending at ``ends``, and the text of each word.

    Words are runs without ASCII white space. A word's hash comes from running sums of a polynomial, so no word is cut out.
    """
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_of_texts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts_of_texts = starts_of_texts[starts_of_texts < len(data)]
    first[starts_of_texts] |= solid[starts_of_texts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    stops = ends[(ends > 0)].astype(np.int64) - 1
    last[stops] |= solid[stops]
    finals = np.flatnonzero(last) + 1
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.add.accumulate((data.astype(_U) + _U(1)) * power[: len(data)])])
    return _mix((sums[finals] - sums[starts]) * inverse[starts]), np.searchsorted(ends, starts, side="right")


def shingle_sets(texts: pa.StringArray, n_words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        base = offsets[at]
        hashes, owner = word_hashes(data[base : offsets[to]], (offsets[at + 1 : to + 1] - base))
        edges = np.searchsorted(owner, np.arange(to - at + 1))
        rolled = None
        if len(hashes) >= n_words:
            m = len(hashes) - n_words + 1
            rolled = hashes[:m].copy()
            for k in range(1, n_words):
                rolled = rolled * _P + hashes[k : k + m]
            rolled = _mix(rolled)
        for i in range(to - at):
            a, b = int(edges[i]), int(edges[i + 1])
            if b - a >= n_words:
                yield np.unique(rolled[a : b - n_words + 1])
            elif b > a:
                short = np.array([b - a], _U)
                for h in hashes[a:b]:
                    short = short * _P + h
                yield _mix(short)
            else:
                yield np.zeros(0, _U)
        at = to


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, kept to 16 bits each."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, ((x[None, at : at + 4096] ^ _XOR) * _MUL).min(1), out=out)
    return ((out * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal values with which P(similarity >= threshold), under a uniform prior, is at least the tolerance.

    The posterior is a beta distribution, and its tail a binomial sum: P(Bin(n + 1, threshold) <= matches).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int] = LEAST) -> np.ndarray:
    """Which of the rows of two signature matrices (or of one row and a matrix) stay candidates."""
    alive = np.arange(len(right))
    matches = np.zeros(len(right), np.int32)
    for n, m in least.items():
        a = left if len(left) == 1 else left[alive]
        matches[alive] += (a[:, n - STEP : n] == right[alive, n - STEP : n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    return alive


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sigs, sizes = [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            keys.append(np.array([s.sum(), _mix(s ^ _P).sum(), len(s)], _U).tobytes())
            sigs.append(signature(s).tobytes() if len(s) else b"")
        columns = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "shingles", "key", "sig"])


def hang_together(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
    """Edges that join, within each group, the nodes whose signatures stay candidates of each other."""
    nodes, sig = batch.column("node").to_numpy(), fixed_binary(batch.column("sig"), 2 * HASHES, np.uint16)
    bounds = np.append(starts, batch.num_rows)
    sizes = np.diff(bounds)
    twos = bounds[:-1][sizes == 2]
    alive = survivors(sig[twos], sig[twos + 1]) if len(twos) else np.zeros(0, int)
    us, vs = [nodes[twos[alive]]], [nodes[twos[alive] + 1]]
    for a, b in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
        comp, s, own = np.arange(b - a), sig[a:b], nodes[a:b]
        for u in range(b - a - 1):
            others = u + 1 + np.flatnonzero(comp[u + 1 :] != comp[u])
            if len(others):
                met = others[survivors(s[u : u + 1], s[others])]
                joined, which = np.unique(comp[met], return_index=True)
                if len(joined):
                    us.append(np.full(len(joined), own[u]))
                    vs.append(own[met[which]])
                    comp[np.isin(comp, joined)] = comp[u]
    u, v = np.concatenate(us), np.concatenate(vs)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if len(u) else None


def overlaps(sets: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[x] and sets[y]."""
    if len(xs) <= 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(xs, ys, strict=True)], np.int64)
    # many pairs of few sets: count shared values by products of membership matrices, some columns at a time
    used, inverse = np.unique(np.concatenate([xs, ys]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    shared = np.bincount(column) > 1
    column = (np.cumsum(shared) - 1)[column][shared[column]]
    owner = owner[shared[np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]]]
    both = np.zeros((len(used), len(used)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 1 << 15
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(used), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m @ m.T
    return both[inverse[: len(xs)], inverse[len(xs) :]].astype(np.int64)


def verify(batch: pa.RecordBatch, starts: np.ndarray, threshold: float = THRESHOLD) -> pa.RecordBatch | None:
    """For each group's nodes, the weight of the nodes linked to each and the smallest node it hangs together with."""
    node, weight, block = (batch.column(c).to_numpy() for c in ("node", "weight", "b"))
    first, second = batch.column("i").to_numpy(), batch.column("j").to_numpy()
    sig = fixed_binary(batch.column("sig"), 2 * HASHES, np.uint16)
    values, offsets = lists(batch.column("shingles"))
    values = values.view(np.uint64)
    out_node, out_links, out_to = [], [], []
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
        rows = a + np.unique(node[a:b], return_index=True)[1]  # a node whose text lies in several rows came several times
        if len(rows) < 2:
            continue
        n, links, to = len(rows), np.zeros(len(rows), np.int64), np.arange(len(rows))
        xs, ys = [], []
        same = first[a] == second[a]
        for u in range(n):
            others = np.arange(u + 1, n) if same else np.flatnonzero(block[rows] == second[a]) if block[rows[u]] == first[a] else ()
            if len(others):
                met = others[survivors(sig[rows[u] : rows[u] + 1], sig[rows[others]])]
                xs.append(np.full(len(met), u))
                ys.append(met)
        xs, ys = (np.concatenate(x) if x else np.zeros(0, int) for x in (xs, ys))
        if len(xs):
            sets = [values[offsets[r] : offsets[r + 1]] for r in rows]
            size = np.array([len(s) for s in sets])
            shared = overlaps(sets, xs, ys)
            linked = shared >= threshold * (size[xs] + size[ys] - shared) - 1e-9
            xs, ys = xs[linked], ys[linked]
            np.add.at(links, xs, weight[rows[ys]])
            np.add.at(links, ys, weight[rows[xs]])
            while True:
                least = to.copy()
                np.minimum.at(least, xs, to[ys])
                np.minimum.at(least, ys, to[xs])
                least = least[least]
                if (least == to).all():
                    break
                to = least
        keep = links > 0
        out_node.append(node[rows[keep]])
        out_links.append(links[keep])
        out_to.append(node[rows[to[keep]]])
    if not out_node:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_node, out_links, out_to)], names=["node", "links", "to"])


def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), flat], names=["node", "shingles"])


def with_size(rows: DataFrame, sizes: DataFrame, group: str, block: int) -> DataFrame:
    """``rows`` with the ``size`` of their group if it is more than a block, else 1: only large groups are looked up."""
    large = materialize(sizes.where(F.col("size") > block), "ngram-large")
    large = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    return rows.join(large, group, "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))


def per_class(found: DataFrame) -> DataFrame:
    """``found``, one row per class, to be joined to rows by label: broadcast up to BROADCAST_GROUPS, so that a large class is not shuffled to one task."""
    written = materialize(found, "ngram-first")
    return F.broadcast(written) if written.count() <= BROADCAST_GROUPS else written


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with words: doc_id, h (of the text), label (number of its class), n_links; then those without, label null."""
    keyed = docs.select("doc_id", empty_if_null("text").alias("text"), F.xxhash64(empty_if_null("text")).alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = keyed.mapInArrow(sketch, f"doc_id {kind}, h long, shingles long, key binary, sig binary")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "ngram-sketch")
    worded = seen.where("shingles > 0")
    sets = worded.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min_by(F.struct("h", "sig", "doc_id"), "row").alias("r"))
    sets = materialize(sets.select("key", "node", "weight", "r.h", "r.sig", F.col("r.doc_id").alias("rep_id")), "ngram-sets")

    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)])
    banded = sets.select("node", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(shared, "bucket").join(sets.select("node", "sig"), "node")
    edges = map_groups(block_pairs(members, "bucket", "size", "node", BUCKET_BLOCK), ["bucket", "i", "j"], hang_together, "u long, v long")
    clusters = materialize(components(edges), "ngram-clusters")

    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    wanted = materialize(clusters.join(sets.drop("key"), "node"), "ngram-wanted")
    who = wanted.select("node", "h", "rep_id")
    who = F.broadcast(who) if wanted.count() <= BROADCAST_GROUPS else who
    texts = keyed.alias("d").join(who.alias("w"), (F.col("d.h") == F.col("w.h")) & F.col("d.doc_id").eqNullSafe(F.col("w.rep_id"))).select("node", "text")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))  # one of the rows that agree in doc_id and text
    shingles = texts.mapInArrow(reshingle, "node long, shingles array<long>")
    blocks = with_size(wanted.select("node", "label", "weight", "sig"), sizes, "label", CLUSTER_BLOCK).join(shingles, "node")
    found = map_groups(block_pairs(blocks, "label", "size", "node", CLUSTER_BLOCK), ["label", "i", "j"], verify, "node long, links long, to long")
    found = materialize(found, "ngram-links")
    classes = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    per_set = sets.select("key", "node", "weight").join(classes, "node", "left").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    per_set = per_set.select("key", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rows = seen.join(per_set, "key", "left").where("shingles > 0").select("doc_id", "h", "label", "n_links")
    wordless = seen.where("shingles = 0").select("doc_id", "h", F.lit(None).cast("long").alias("label"), F.lit(0).cast("long").alias("n_links"))
    out = materialize(rows.unionByName(wordless), "ngram-rows")
    for done in (seen, sets, clusters, wanted, found):
        forget(done)
    return out


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, class_id, n_links, kept.

    Two rows are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; n_links counts the
    other rows linked directly, copies included, and class_id is the smallest doc_id reachable by links. ``kept`` marks one
    row per class: the one of that doc_id. Texts of fewer than five words are one shingle; null texts and those without words
    link with nothing and stay. Rows that agree in doc_id count as rows of their own, of which each or none is kept; a null
    doc_id is the class's only where all are null. A pair is missed only if it meets in no band (3e-6 at 0.8, less above) or is
    pruned against its posterior (1e-6).
    """
    rows = near_classes(docs)
    first = per_class(rows.where("n_links > 0").groupBy("label").agg(F.min("doc_id").alias("class_id")))
    out = rows.where("n_links > 0").join(first, "label").select("doc_id", "class_id", "n_links")
    alone = rows.where("n_links = 0").select("doc_id", F.col("doc_id").alias("class_id"), "n_links")
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, one document of each class of :func:`ngram_join`: that of the smallest doc_id (null last), then hash.

    Rows that agree in doc_id and text are one document and stay or go together. Texts without words stay.
    """
    rows = near_classes(docs).where("n_links > 0").select("label", F.struct(F.col("doc_id").isNull(), "doc_id", "h").alias("me"), id_key().alias("id_key"), "h")
    first = per_class(rows.groupBy("label").agg(F.min("me").alias("first")))
    gone = rows.join(first, "label").where(F.col("me") != F.col("first")).select("id_key", "h").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(id_key().alias("id_key"), F.xxhash64(empty_if_null("text")).alias("h"), whole)
    return keyed.join(gone, ["id_key", "h"], "left_anti").select("row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links."""
    return ngram_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingle AS (
  SELECT rid, unnest(CASE WHEN len(w) >= {WORDS} THEN list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM worded
), size AS (SELECT rid, count(*) AS n FROM shingle GROUP BY rid
), link AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL)
  JOIN size sa ON sa.rid = a JOIN size sb ON sb.rid = b WHERE k >= {THRESHOLD} * (sa.n + sb.n - k) - 1e-9
), reach AS (SELECT rid, doc_id AS label FROM worded UNION SELECT l.b, r.label FROM reach r JOIN link l ON l.a = r.rid
), class AS (SELECT rid, min(label) AS class_id FROM reach GROUP BY rid)
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE a = worded.rid) AS n_links, doc_id IS NOT DISTINCT FROM class_id AS kept FROM worded JOIN class USING (rid)
"""

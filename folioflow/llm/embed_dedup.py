"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one row kept per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import forget, materialize, read
from folioflow.llm.components import components
from folioflow.llm.groups import lists, map_groups, spread_labels

MIN_COSINE = 0.95
#: Centres are fitted to so many vectors at most, drawn by hash; every vector is assigned.
SAMPLE, ROUNDS = 16_384, 8
#: A vector is compared in so many cells on average at most: where more cells would mean more than that, there are fewer cells.
PROBES = 6.0
#: Bytes of vectors, as doubles, in a block: a task compares two blocks at a time, by tiles of TILE rows.
BLOCK_BYTES, TILE = 4 << 20, 1024


def n_cells(vectors: int, sample: int) -> int:
    """Cells grow with the square root of the vectors, as far as the sample has four vectors for each."""
    return max(1, min(sample // 4, math.isqrt(vectors) // 2))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centres of the unit rows of ``x``: each is the normalised mean of the rows nearest to it by cosine."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 2048))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def probes(x: np.ndarray, centres: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's home cell and a mask of the cells it must be compared in.

    Let x and y be unit vectors of cosine >= c, so |x - y| <= d = sqrt(2 - 2c), with homes h and g. By how much x prefers h to
    g and y prefers g to h add up to (x - y)(h - g) <= d |h - g|, so one of the two is at most half of it. Probing each cell
    that is within d/2 |h - g| of the home one thus brings one of them to the other's home: no link is lost.
    """
    score = x @ centres.T
    home = score.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) / 2 + 1e-9
    mask = score[np.arange(len(x)), home][:, None] - score <= reach * apart[home]
    return home, mask


def choose_centres(x: np.ndarray, vectors: int, min_cosine: float) -> np.ndarray:
    """Centres for ``vectors`` rows from a sample ``x`` of unit rows: as many as :func:`n_cells` says, halved until rows probe PROBES cells at most on average.

    Vectors that do not cluster would else be sent to a fixed share of ever more cells, which compares no less.
    """
    k = n_cells(vectors, len(x))
    while True:
        centres = spherical_kmeans(x, k)
        if k == 1 or np.mean([probes(part, centres, min_cosine)[1].sum(1).mean() for part in np.array_split(x, max(1, len(x) // 2048))]) <= PROBES:
            return centres
        k //= 2


def _unit(column: pa.Array) -> np.ndarray:
    values, offsets = lists(column)
    x = values[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(column), -1)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # squares of very small or large components would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centres: dict[int, np.ndarray], min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("dim").to_numpy()
            for dim in np.unique(width):
                part = batch.filter(pa.array(width == dim))
                if int(dim) in centres:
                    home, mask = probes(_unit(part.column("embedding")), centres[int(dim)], min_cosine)
                else:  # a length that the sample has not seen is one cell
                    home, mask = np.zeros(part.num_rows, int), np.ones((part.num_rows, 1), bool)
                cells = pa.ListArray.from_arrays(np.concatenate([[0], mask.sum(1).cumsum()]).astype(np.int32), pa.array(np.nonzero(mask)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), cells], names=[*part.schema.names, "home", "cells"])

    return run


def _compare(min_cosine: float):
    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        node, weight, home = (batch.column(c).to_numpy() for c in ("node", "weight", "home"))
        cell, first, second, bi, bj = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "in_i", "in_j"))
        probed, at = lists(batch.column("cells"))
        out = [[], [], []]
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            rows, cols = a + np.flatnonzero(bi[a:b]), a + np.flatnonzero(bj[a:b])
            if not len(rows) or not len(cols):
                continue
            unit = _unit(batch.column("embedding").slice(a, b - a))
            left, right = unit[rows - a], unit[cols - a]
            met = []
            for p in range(0, len(left), TILE):
                for q in range(0, len(right), TILE):
                    i, j = np.nonzero(left[p : p + TILE] @ right[q : q + TILE].T >= min_cosine)
                    met.append((p + i, q + j))
            x, y = (np.concatenate(m) for m in zip(*met, strict=True))
            x, y = rows[x], cols[y]
            inside = home[y] == cell[a]
            # both at home here: each pair counts once. Else it also meets in the home of y if x probes that: the smaller cell counts it.
            take = np.where(inside, node[x] < node[y], True)
            for k in np.flatnonzero(~inside & (home[y] < cell[a])):
                take[k] = home[y[k]] not in probed[at[x[k]] : at[x[k] + 1]]
            x, y = x[take] - a, y[take] - a
            if not len(x):
                continue
            used, local = np.unique(np.concatenate([x, y]), return_inverse=True)
            u, v = local[: len(x)], local[len(x) :]
            links = np.bincount(u, weight[a + used[v]], len(used)) + np.bincount(v, weight[a + used[u]], len(used))
            names = node[a + used]
            order = np.argsort(names)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            to = names[order][spread_labels(len(names), rank[u], rank[v])][rank]
            for kept, new in zip(out, (names, links.astype(np.int64), to), strict=True):
                kept.append(new)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["node", "links", "to"])

    return work


def usable(embedding: str) -> Column:
    """Whether a vector is not null nor empty, has only finite components and one that is not zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def embed_dedup(vectors: DataFrame, min_cosine: float = MIN_COSINE, cells: int | None = None) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding; others are ignored): vec_id, n_links, component_id, kept.

    Rows are linked when the cosine of their embeddings, in double precision, is at least min_cosine; n_links counts the other
    rows linked directly, component_id is the smallest vec_id reachable. Null, empty and zero vectors, and those with null or
    non-finite components, link with nothing, nor do rows without a vec_id; vectors of different lengths never link. Equal
    vectors are one node that weighs as many rows, so repeated rows are links of each other. Cells only save work: see
    :func:`probes`. A cell's rows are compared in blocks of BLOCK_BYTES; only counts and one edge per node leave a task.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    nodes = rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # numbered, as different vectors may have one vec_id
    nodes = materialize(nodes.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "embed-nodes")
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("least", "embedding")).limit(SAMPLE).select("dim", "embedding").toArrow().combine_chunks()
    centres = {}
    for dim in sorted(set(sample.column("dim").to_pylist())):
        part = sample.filter(pc.equal(sample.column("dim"), dim)).column("embedding").combine_chunks()
        unit = _unit(part.chunk(0) if isinstance(part, pa.ChunkedArray) else part)
        share = total * len(part) // max(1, sample.num_rows)
        centres[dim] = spherical_kmeans(unit, cells) if cells else choose_centres(unit, share, min_cosine)
    assigned = nodes.select("node", "weight", "dim", "embedding").mapInArrow(_assign(centres, min_cosine), f"node long, weight long, dim int, embedding array<{kind}>, home int, cells array<int>")
    assigned = materialize(assigned, "embed-cells")

    members = assigned.select("node", "weight", "dim", "home", "cells", F.explode("cells").alias("cell"), "embedding")
    sizes = assigned.select("dim", F.explode("cells").alias("cell"), "home").groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum((F.col("home") == F.col("cell")).cast("int")).alias("n_home"))
    # one row per cell, of which there are no more than a quarter of the sample, and per length that the sample lacks
    sizes = materialize(sizes, "embed-sizes")
    blocks = members.join(F.broadcast(sizes) if sizes.count() <= SAMPLE else sizes, ["dim", "cell"])
    rows_of = F.greatest(F.lit(16), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    own, all_ = (F.ceil(F.col(c) / rows_of).cast("int") for c in ("n_home", "n"))
    mine, other = (F.pmod(F.xxhash64(F.col("node"), F.lit(s)), F.greatest(n, F.lit(1))).cast("int") for s, n in ((1, own), (2, all_)))

    def spots(i: Column, j: Column, n: Column, over_i: bool) -> Column:
        every = F.sequence(F.lit(0), n - 1)
        return F.transform(every, lambda o: F.struct((o if over_i else i).alias("i"), (j if over_i else o).alias("j"), F.lit(not over_i).alias("in_i"), F.lit(over_i).alias("in_j")))

    home = F.col("home") == F.col("cell")
    none = F.array().cast("array<struct<i:int,j:int,in_i:boolean,in_j:boolean>>")
    # home rows of block i meet all rows of block j; a row that is in both comes twice and is told apart by in_i and in_j
    places = F.concat(F.when(home, spots(mine, other, all_, False)).otherwise(none), F.when(F.col("n_home") > 0, spots(mine, other, own, True)).otherwise(none))
    dealt = blocks.select("dim", "cell", "node", "weight", "home", "cells", "embedding", F.explode(places).alias("p")).select("dim", "cell", "p.i", "p.j", "p.in_i", "p.in_j", "node", "weight", "home", "cells", "embedding")
    found = materialize(map_groups(dealt, ["dim", "cell", "i", "j"], _compare(min_cosine), "node long, links long, to long"), "embed-links")

    classes = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    per_node = nodes.join(classes, "node", "left").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    per_node = per_node.select("embedding", "least", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    per_node = materialize(per_node, "embed-classes")
    for done in (nodes, assigned, sizes, found):
        forget(done)
    names = materialize(per_node.groupBy("label").agg(F.min("least").alias("component_id")), "embed-names")
    per_node = per_node.join(names, "label").select("embedding", "component_id", "n_links")
    linked = rows.join(per_node, "embedding").select("vec_id", "n_links", "component_id")
    rest = vectors.where(~(F.col("vec_id").isNotNull() & usable("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return embed_dedup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP7_SQL = f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM numbered WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON len(a.e) = len(b.e) AND a.rid <> b.rid WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}
), reach AS (SELECT rid, vec_id AS label FROM numbered UNION SELECT l.b, r.label FROM reach r JOIN link l ON l.a = r.rid
), component AS (SELECT rid, min(label) AS component_id FROM reach GROUP BY rid)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = numbered.rid) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM numbered JOIN component USING (rid)
"""

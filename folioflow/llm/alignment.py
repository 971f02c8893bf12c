"""Aligning the tokens that two tokenizers make of the same texts, by a sweep over the places where tokens end.

Each token is an event at the byte offset where it ends. The events of both tokenizers are dealt out by document and sorted by
offset; a state machine runs through them and closes a group wherever tokens of both end. It holds the tokens since the last
such place and nothing else. Two tokens are linked if their bytes overlap: each event closes one stretch of bytes that lies in
one token of either side, so there is one link per different offset.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import forget, materialize, read

#: Folder of the tokenizers, unless the session's ``spark.folioflow.tokenizers`` names another.
TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Events of one side whose offsets lie in one window of so many bytes travel as one row.
WINDOW = 1 << 16
#: Bytes of texts that are encoded together.
PART = 1 << 20
#: Links whose pairs are looked up together.
BLOCK_LINKS = 1 << 21
#: Stretches of text whose tokens a task remembers, and characters of one at most.
REMEMBERED, LONGEST = 1 << 18, 64

#: Characters whose kinds do not hang on a library's Unicode tables.
PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
# Fixed value: how byte-level vocabularies of this family split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_files(spark: SparkSession) -> tuple[str, str]:
    folder = spark.conf.get("spark.folioflow.tokenizers", TOKENIZERS)
    return f"{folder}/{FILE_A}", f"{folder}/{FILE_B}"


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, with the bytes of each token.

    A text is cut at single spaces between two characters that are no white space, and each stretch is encoded by itself, with
    a space before it. No token of either side crosses such a place: A splits texts before a space that a word follows, and no
    piece of B has its mark for a space behind another character. So the tokens are those of the whole text.
    """

    def __init__(self, file_a: str, file_b: str) -> None:
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        letters = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # A's merges have rising ids, so its entries as ranks give the same tokens in a quicker library, where both agree on letters
        known = {x: i for i, x in enumerate(self.bytes_a) if i not in self.a.get_added_tokens_decoder()}
        self.quick = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.codes = ["H" if len(x) <= 1 << 16 else "I" for x in (self.bytes_a, self.bytes_b)]
        self.dtypes = [np.dtype(c) for c in self.codes]
        self.lengths = [np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def stretches(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        out, whole = [], True
        for word in text.split(" "):
            # a stretch neither begins nor ends with white space, or with what some call so
            sound = bool(word) and not (word[0].isspace() or word[-1].isspace() or word[0] in ODD or word[-1] in ODD)
            if sound and whole:
                out.append(word)
            else:
                if out:
                    out[-1] += " " + word
                else:
                    out.append(word)
            whole = sound
        return out

    def learn(self, new: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """The ids of both sides for each stretch, or None where they do not spell it out."""
        spaced = [" " + s for s in new]
        ids_a = [self.quick.encode_ordinary(s) if PLAIN.fullmatch(s) else None for s in spaced]
        rest = [i for i, ids in enumerate(ids_a) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([spaced[i] for i in rest], add_special_tokens=False)):
            ids_a[i] = e.ids
        ids_b = self.b.encode(new, num_threads=1)
        out = {}
        for s, want, a, b in zip(new, spaced, ids_a, ids_b):
            want = want.encode()
            right = b"".join([self.bytes_a[i] for i in a]) == want and b"".join([self.bytes_b[i] for i in b]) == want
            out[s] = (array(self.codes[0], a).tobytes(), array(self.codes[1], b).tobytes()) if right else None
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """The ids of both sides for whole texts; None for those that are null or empty, or that either side does not spell out."""
        cut = [self.stretches(t) if t else [] for t in texts]
        new = list({s for c in cut for s in c if s not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({s for c in cut for s in c})
        self.known |= (learnt := self.learn(new))
        out = []
        for c in cut:
            found = [self.known[s] for s in c]
            out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])) if found and None not in found else None)
        for s in learnt:  # what is long hardly comes again
            if len(s) > LONGEST:
                del self.known[s]
        return out


#: Characters that older tables count as white space.
ODD = frozenset("᠎​﻿")


@cache
def tokens(file_a: str, file_b: str) -> Tokens:
    return Tokens(file_a, file_b)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts whose texts are about PART bytes together, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")) - at)
            yield batch.slice(at, n)
            at += n


def end_events(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """The end events of ``docs`` (row, doc_id, text) on both sides: row, doc_id, at, side (0: A, 1: B), ids.

    A row holds the ids of one side's tokens that end in one window of WINDOW bytes, in order; ``at`` numbers windows. A
    document without tokens has one row without ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(*files)
        for batch in _parts(batches):
            of, at, side, ids = [], [], [], []
            for i, found in enumerate(t.encode(batch.column("text").to_pylist())):
                if found is None:
                    found = (b"", b"")
                    of.append(i), at.append(0), side.append(0), ids.append(b"")
                for s, x in enumerate(found):
                    here = np.frombuffer(x, t.dtypes[s])
                    cuts = [0]
                    if len(here):
                        ends = np.cumsum(t.lengths[s][here])
                        cuts = [0, *np.searchsorted(ends, np.arange(WINDOW, ends[-1] + WINDOW, WINDOW), "right")]
                    for w, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            of.append(i), at.append(w), side.append(s), ids.append(here[a:b].tobytes())
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(at, pa.int32()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())], names=["row", "doc_id", "at", "side", "ids"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, at int, side int, ids binary")


@dataclass
class Run:
    """Whole groups of one document, in order, beginning at byte ``start``: tokens of both sides, and how many each group has."""

    row: int
    doc_id: object
    last: bool
    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    in_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    in_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: int = 0
    link_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    link_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Sweep:
    """The state of a document's sweep: the tokens of both sides since the last place where both ended."""

    def __init__(self, row: int, doc_id: object, t: Tokens) -> None:
        self.row, self.doc_id, self.t, self.start = row, doc_id, t, 0
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.reached = [0, 0]

    def take(self, side: int, ids: bytes) -> None:
        new = np.frombuffer(ids, self.t.dtypes[side]).astype(np.int64)
        if len(new):
            ends = self.reached[side] + np.cumsum(self.t.lengths[side][new])
            self.reached[side] = int(ends[-1])
            self.ids[side] = np.concatenate([self.ids[side], new])
            self.ends[side] = np.concatenate([self.ends[side], ends])

    def close(self, last: bool) -> Run | None:
        """The groups that are whole by now."""
        (a, b), (ends_a, ends_b) = self.ids, self.ends
        run = Run(self.row, self.doc_id, last, start=self.start)
        if len(a) and len(b):
            over = np.searchsorted(ends_b, ends_a)  # by token of A the token of B that covers its last byte
            both = ends_b[np.minimum(over, len(b) - 1)] == ends_a
            cut_a, cut_b = np.flatnonzero(both), over[both]
            if len(cut_a):
                n_a, n_b = int(cut_a[-1]) + 1, int(cut_b[-1]) + 1
                alone = np.ones(n_b, bool)
                alone[cut_b] = False
                under = np.searchsorted(ends_a, ends_b[:n_b][alone])
                run.a, run.b = a[:n_a], b[:n_b]
                run.in_a, run.in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
                run.ends, self.start = ends_a[cut_a], int(ends_a[cut_a[-1]])
                run.link_a, run.link_b = np.concatenate([a[:n_a], a[under]]), np.concatenate([b[over[:n_a]], b[:n_b][alone]])
                self.ids, self.ends = [a[n_a:], b[n_b:]], [ends_a[n_a:], ends_b[n_b:]]
        return run if last or len(run.a) else None


def runs(batches: Iterator[pa.RecordBatch], files: tuple[str, str]) -> Iterator[Run]:
    """Streams through event rows sorted by document, window and side."""
    t, now, window = tokens(*files), None, 0
    for batch in batches:
        for row, doc_id, at, side, ids in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "at", "side", "ids")]):
            if now is not None and now.row != row:
                yield now.close(True)
                now = None
            if now is None:
                now, window = Sweep(row, doc_id, t), at
            elif at != window:
                window = at
                if (run := now.close(False)) is not None:
                    yield run
            now.take(side, ids)
    if now is not None:
        yield now.close(True)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())


def _swept(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    return end_events(_numbered(docs), files).repartition("row").sortWithinPartitions("row", "at", "side")


def align(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """The groups of ``docs`` (doc_id, text; others are ignored): row, doc_id, start and end in bytes, a and b (ids in order).

    Offsets count bytes of a space and the text. ``files`` are those of the tokenizers, by default the session's. Texts that
    are null or empty, or that either side's tokens do not spell out, have no groups. ``row`` tells repeated rows apart, so that
    each has groups of its own; doc_ids may be null.
    """
    files = files or tokenizer_files(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in _first(batches):
            if schema is None:
                schema = batch[0].schema.field("doc_id").type
            for r in runs(batch[1], files):
                n = len(r.ends)
                if n:
                    lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(k)]).astype(np.int32), x.astype(np.int32)) for k, x in ((r.in_a, r.a), (r.in_b, r.b))]
                    starts = np.concatenate([[r.start], r.ends[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r.row)), pa.array([r.doc_id] * n, schema), pa.array(starts), pa.array(r.ends), *lists], names=["row", "doc_id", "start", "end", "a", "b"])

    return _swept(docs, files).mapInArrow(run, f"row long, doc_id {kind}, start long, end long, a array<int>, b array<int>")


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[pa.RecordBatch]]]:
    """The first batch, if any, and all of them."""
    first = next(batches, None)
    if first is not None:
        yield first, (b for part in ([first], batches) for b in part)


class Spelling:
    """The digest of a document's groups, spelt ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, most: int) -> None:
        self.most, self.words = most, [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(most)]

    def text(self, r: Run) -> bytes:
        """The groups of a run, each with a semicolon behind it."""
        out = np.empty(len(r.a) + len(r.b), np.int64)
        to_a, to_b = np.cumsum(r.in_a), np.cumsum(r.in_b)
        at_a = np.arange(len(r.a)) + np.repeat(to_b - r.in_b, r.in_a)
        at_b = np.arange(len(r.b)) + np.repeat(to_a, r.in_b)
        out[at_a], out[at_b] = r.a, r.b
        out[at_a[to_a - 1]] += self.most
        out[at_b[to_b - 1]] += 2 * self.most
        return b"".join(map(self.words.__getitem__, out.tolist()))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


STATS = "row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: ``pairs`` of a block, sorted, with ``times``; ``docs`` has rows, ``sizes`` how many different pairs each has, ``steps`` and ``counts`` which and how often.
BLOCK = "block string, pairs array<long>, times array<long>, docs array<long>, sizes binary, steps binary, counts binary"


class Block:
    """Links of some documents, up to about BLOCK_LINKS, as different pairs: what stands in one row of the table."""

    def __init__(self) -> None:
        self.rows, self.pairs, self.n = [], [], 0

    def add(self, r: Run) -> None:
        if len(r.link_a):
            self.rows.append(r.row)
            self.pairs.append(r.link_b << 32 | r.link_a)
            self.n += len(r.link_a)

    def done(self) -> dict:
        own = [np.unique(p, return_counts=True) for p in self.pairs]
        each, counts = np.concatenate([p for p, _ in own]), np.concatenate([n for _, n in own])
        pairs, which = np.unique(each, return_inverse=True)
        sizes = np.array([len(p) for p, _ in own])
        steps = np.diff(which, prepend=0)
        first = np.cumsum(sizes) - sizes
        steps[first] = which[first]
        return {
            "block": f"{self.rows[0]}:{int(pairs[0])}:{self.n}:{len(pairs)}:{len(self.rows)}", "pairs": pairs, "times": np.bincount(which, counts, len(pairs)).astype(np.int64), "docs": np.array(self.rows),
            "sizes": packed(sizes), "steps": packed(steps), "counts": packed(counts),
        }


def alignment_stats(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link counts as often as its pair of ids is linked in all texts. n_best are the links whose count is the highest of their
    id of B, ties included; count_sum is the sum of the links' counts. Texts that are null or empty, or that either side's
    tokens do not spell out, have zeros and an empty digest. Repeated rows have a row and links each; doc_ids may be null.

    The sweep writes a row per document, and blocks of links. Counts of pairs are summed up from blocks, and each block gets
    those of its different pairs back, so no link is shuffled by itself and a pair that is everywhere counts once a block.
    """
    files = files or tokenizer_files(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats, blocks = STATS.format(kind=kind), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(*files)
        spelling = Spelling(max(map(len, t.lengths)))
        for first, every in _first(batches):
            schema = pa.schema([("row", pa.int64()), ("doc_id", first.schema.field("doc_id").type), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                                ("block", pa.string()), *[(n, pa.list_(pa.int64())) for n in ("pairs", "times", "docs")], *[(n, pa.binary()) for n in ("sizes", "steps", "counts")]])
            rows, block = [], Block()
            n, digest, held = np.zeros(4, np.int64), hashlib.sha256(), b""
            for r in runs(every, files):
                if len(r.a):
                    n += [len(r.a), len(r.b), len(r.ends), len(r.link_a)]
                    text = held + spelling.text(r)
                    digest.update(text[:-1])
                    held = text[-1:]  # the last semicolon waits for a group behind it
                    block.add(r)
                if r.last:
                    rows.append({"row": r.row, "doc_id": r.doc_id, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), n.tolist())), "groups_sha256": digest.hexdigest() if n[0] else ""})
                    n, digest, held = np.zeros(4, np.int64), hashlib.sha256(), b""
                if block.n >= BLOCK_LINKS:
                    rows.append(block.done())
                    block = Block()
                if len(rows) >= 512 or (rows and "block" in rows[-1]):
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if block.n:
                rows.append(block.done())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    swept = materialize(_swept(docs, files).mapInArrow(run, f"{stats}, {blocks}"), "align-sweep")
    held = swept.where("block IS NOT NULL")
    totals = held.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"))
    totals = materialize(totals.withColumn("b", F.shiftright("pair", 32)), "align-pairs")
    best = totals.groupBy("b").agg(F.max("total").alias("best"))
    worth = totals.join(best, "b").select("pair", (F.col("total") * 2 + (F.col("total") == F.col("best")).cast("int")).alias("worth"))
    wanted = held.select("block", F.posexplode("pairs").alias("place", "pair"))
    given = wanted.join(worth, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "worth")).alias("given"))
    by_row = held.select("block", "docs", "sizes", "steps", "counts").join(given, "block").select("docs", "sizes", "steps", "counts", "given")
    sums = materialize(by_row.mapInArrow(_block_sums, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "align-sums")
    forget(totals)
    zero = F.lit(0).cast("long")
    whole = swept.where("block IS NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            given = batch.column("given")[i].values
            place, worth = given.field("place").to_numpy(), given.field("worth").to_numpy()
            value = np.zeros(len(place), np.int64)
            value[place] = worth
            docs = batch.column("docs")[i].values.to_numpy()
            sizes, steps, counts = (unpacked(batch.column(c)[i].as_py()) for c in ("sizes", "steps", "counts"))
            ends = np.cumsum(sizes)
            run = np.cumsum(steps)
            which = run - np.repeat(np.concatenate([[0], run[ends[:-1] - 1]]), sizes)
            v = value[which]
            best, total = (np.add.reduceat(x, ends - sizes) for x in (counts * (v & 1), counts * (v >> 1)))
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of both tokenizers group and link up in every whole text."""
    return alignment_stats(read(spark, sf_dir, "documents").select("doc_id", "text"))

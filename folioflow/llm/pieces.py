"""SentencePiece encoding by sampling without replacement, and decoding.

The pieces of a vocabulary span a lattice over each text, weighted so that a path's weight is the product of its pieces'
probabilities. Distinct segmentations come from an A-star search on Gumbel-perturbed log-probabilities: the best path is drawn
from the lattice backwards-filtered; what it leaves out falls into one region for each of its edges (same beginning, another
edge there, anything after), whose largest perturbed value is a Gumbel truncated at that of the path. The best region is opened
next, and so on: the paths come in the order of their perturbed values, as if all paths had been perturbed and sorted. Texts of
a batch are searched side by side in numpy. Random numbers are a hash of the row's key, the sample and the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Exponent of the pieces' probabilities: below 1 the samples differ more.
ALPHA = 0.5
#: Characters that are searched side by side, and edges of the lattices that are kept from one slice to the next.
SLICE, KEPT_EDGES = 1 << 17, 1 << 20
SPACE = "▁"
#: Stands for a SPACE that a text has itself, which is written as bytes; valid text has no such code point.
OWN_SPACE = "\ud800"
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces by id, the ids of the 256 bytes, and log-probabilities: Zipf's law over the order in which the pieces stand."""

    pieces: list[str]
    special: frozenset[int]
    byte_ids: list[int]
    log_p: np.ndarray
    trie: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default=None)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i))
        rank = np.argsort(np.argsort(-np.array([m.get_score(i) if i not in special else -np.inf for i in range(n)]), kind="stable"))
        p = 1 / (rank + 10.0)
        return Vocabulary([m.id_to_piece(i) for i in range(n)], special, byte_ids, np.log(p / p.sum())).built()

    @staticmethod
    def hashed(key: np.ndarray, size: int) -> np.ndarray:
        """Where to look for a key first in a table of ``size`` slots, a power of two."""
        return ((key.view(np.uint64) * _STEP) >> _U(65 - size.bit_length())).astype(np.int64)

    def built(self) -> Vocabulary:
        """With the trie: the states that first characters lead to, a hash table of entries (state * 2**21 + character) * 2**21 + state they lead to, and the piece of each state."""
        states, piece = {(0, -1): 0}, [-1]
        for i, text in enumerate(self.pieces):
            if i not in self.special:
                s = 0
                for c in text:
                    s = states.setdefault((s, ord(c)), len(states))
                    if s == len(piece):
                        piece.append(-1)
                piece[s] = i
        if len(states) >> 21:
            raise ValueError(f"a vocabulary of {len(states)} states is too large")
        begin = np.zeros(max(c for s, c in states if s == 0) + 2, np.int64)  # the last one stands for all characters behind
        size = 1 << (4 * len(states)).bit_length()  # under a quarter of the slots are taken, so looking for a free one ends
        table = np.full(size, -1, np.int64)
        for (s, c), v in states.items():
            if s == 0 and c >= 0:
                begin[c] = v
            elif c >= 0:
                spot = int(self.hashed(np.array([(s << 21) + c]), size)[0])
                while table[spot] >= 0:
                    spot = (spot + 1) & (len(table) - 1)
                table[spot] = (((s << 21) + c) << 21) + v
        self.trie = (begin, table, np.array(piece, np.int32))
        for text in (self.pieces[i] for i in range(len(self.pieces)) if i not in self.special):
            if SPACE in text.lstrip(SPACE) or "\n" in text:
                raise ValueError(f"a piece crosses words or lines: {text!r}")
        return self


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of texts, which unit stands where, and in which text. A text that is not empty has one more space at its beginning.

    No piece crosses the beginning of a run of spaces, nor a line end, so a text's lattice is a chain of those of its units: spaces
    with what follows them, line ends, and what follows a line end without spaces.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.diff(ends) > 0
    text = np.insert(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1][some] - ends[0], 32)
    begins = ends[:-1] - ends[0] + some.cumsum() - some
    space, line = text == 32, text == 10
    opens = line.copy()
    opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    opens[begins[some]] = True
    cuts = np.flatnonzero(opens)
    doc = np.flatnonzero(some)[np.searchsorted(begins[some], cuts, side="right") - 1]
    units = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(text))), pa.py_buffer(text)]).dictionary_encode()
    return units.dictionary, units.indices.to_numpy(), doc


class Lattices:
    """The lattices of units seen so far, end to end: edges by place, with the running probability of the edges of each place."""

    def __init__(self, vocabulary: Vocabulary, alpha: float, kept_edges: int | None = None) -> None:
        self.v, self.kept_edges = vocabulary, kept_edges or KEPT_EDGES
        self.weight, self.floor = vocabulary.log_p * alpha, vocabulary.log_p.min() - 10
        self.alpha = alpha
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by unit
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int16)  # by place: its first edge, and how many there are
        self.edge_length, self.log_p, self.upto = np.zeros(0, np.int16), np.zeros(0), np.zeros(0)
        self.what = np.zeros(0, np.int32)  # by edge: the piece, or -1 - the number of a character that is no piece
        self.spelt: dict[int, int] = {}  # characters that are no piece, with their numbers
        self.spelt_ids: list[list[int]] = []  # their bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.places = self.edges = 0

    def put(self, name: str, at: int, values: np.ndarray) -> None:
        """Writes values behind the first ``at`` of an array. What is not written of it takes no memory, so it is made large enough for all that is kept."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            grown = np.empty(max(2 * (at + len(values)), 2 * self.kept_edges), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, grown)
            held = grown
        held[at : at + len(values)] = values

    def add(self, units: list[bytes]) -> None:
        raw = b"".join(units)
        text = raw.decode()
        if SPACE in text:
            text = text.replace(SPACE, OWN_SPACE)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[chars == 32] = ord(SPACE)
        size = np.array([len(u) for u in units], np.int64)
        length = np.add.reduceat((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, size.cumsum() - size, dtype=np.int64)
        left = np.repeat(length.cumsum(), length) - np.arange(len(chars))  # characters from a place to its unit's end
        begin, table, piece = self.v.trie
        state = begin[np.minimum(chars, len(begin) - 1)]
        at = np.flatnonzero(state)
        state = state[at]
        found = []  # for each length the places of pieces that long, and the pieces
        while True:
            what = piece[state]
            ends = np.flatnonzero(what >= 0)
            found.append((at[ends], what[ends]))
            more = np.flatnonzero(left[at] > len(found))
            if not len(more):
                break
            at, state = at[more], state[more]
            key = (state << 21) + chars[at + len(found)]
            spot = Vocabulary.hashed(key, len(table))
            entry = table[spot]
            hit = entry >> 21 == key
            off = np.flatnonzero(~hit & (entry >= 0))
            while len(off):  # the slot is another key's: try the next
                spot[off] = (spot[off] + 1) & (len(table) - 1)
                entry[off] = table[spot[off]]
                hit[off] = entry[off] >> 21 == key[off]
                off = off[~hit[off] & (entry[off] >= 0)]
            hit = np.flatnonzero(hit)
            at, state = at[hit], entry[hit] & ((1 << 21) - 1)
        single = np.zeros(len(chars), bool)
        single[found[0][0]] = True
        lost = np.flatnonzero(~single)  # characters that are no piece: their bytes
        if len(lost):
            different, which = np.unique(chars[lost], return_inverse=True)
            for c in different.tolist():
                if c not in self.spelt:
                    self.spelt[c] = len(self.spelt_ids)
                    self.spelt_ids.append([self.v.byte_ids[b] for b in (SPACE if chr(c) == OWN_SPACE else chr(c)).encode()])
            number = np.array([self.spelt[c] for c in different.tolist()])[which]
            lost_weight = self.floor * np.array([len(self.spelt_ids[self.spelt[c]]) for c in different.tolist()])[which] * self.alpha
        # edges stand in the order of what is left behind their place, so a step backwards from the units' ends is a slice
        longest = int(left.max())
        order = np.argsort(left.astype(np.uint16) if longest < 1 << 16 else left, kind="stable")
        count = np.zeros(len(chars), np.int64)
        for p, _ in found:
            count[p] += 1
        count[lost] += 1
        n = count[order]
        cut = np.concatenate([[0], n.cumsum()])
        first = np.empty(len(chars), np.int64)
        first[order] = cut[:-1]
        n_edges = int(cut[-1])
        long, what, stop, value = np.empty(n_edges, np.int16), np.empty(n_edges, np.int32), np.empty(n_edges, np.int64), np.empty(n_edges)
        filled = first.copy()
        levels = [(k, p, w, self.weight[w]) for k, (p, w) in enumerate(found, 1)]
        if len(lost):
            levels.insert(0, (1, lost, -1 - number, lost_weight))
        for k, p, w, weight in reversed(levels):  # long pieces first: they are the likeliest
            e = filled[p]
            long[e], what[e], value[e] = k, w, weight
            stop[e] = np.where(left[p] > k, p + k, len(chars))  # beta is 0 there
            filled[p] = e + 1
        beta = np.zeros(len(chars) + 1)
        bounds = np.bincount(left, minlength=longest + 1).cumsum().tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            lo, hi = int(cut[a]), int(cut[b])
            here = value[lo:hi]
            here += beta[stop[lo:hi]]
            spots = cut[a:b] - lo
            top = np.maximum.reduceat(here, spots)
            beta[order[a:b]] = top + np.log(np.add.reduceat(np.exp(here - np.repeat(top, n[a:b])), spots))
        value -= np.repeat(beta[order], n)
        running = np.concatenate([[0.0], np.cumsum(np.exp(value))])
        inside = running[1:] - np.repeat(running[cut[:-1]], n)
        inside[cut[1:] - 1] = 1.0
        known = len(self.index)
        self.index.update(zip(units, range(known, known + len(units)), strict=True))
        self.put("start", known, self.places + length.cumsum() - length)
        self.put("length", known, length)
        self.put("first", self.places, self.edges + first)
        self.put("count", self.places, count)
        self.put("edge_length", self.edges, long)
        self.put("log_p", self.edges, value)
        self.put("upto", self.edges, inside)
        self.put("what", self.edges, what)
        self.places, self.edges = self.places + len(chars), self.edges + n_edges

    def of(self, units: pa.Array) -> np.ndarray:
        """Numbers of different units."""
        if self.edges > self.kept_edges:
            self.clear()
        units = units.to_numpy(zero_copy_only=False).tolist()  # far quicker than to_pylist
        get = self.index.get
        found = np.array([get(u, -1) for u in units], np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = len(self.index) + np.arange(len(missing))
            self.add([units[i] for i in missing.tolist()])
        return found

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges, end to end, and how many each has."""
        ids = self.what[edges]
        n = np.ones(len(ids), np.int64)
        spelt = np.flatnonzero(ids < 0)
        if len(spelt):
            bytes_of = [self.spelt_ids[k] for k in (-1 - ids[spelt]).tolist()]
            n[spelt] = [len(b) for b in bytes_of]
            begins = (n.cumsum() - n)[spelt]
            ids = np.repeat(ids, n)
            where = np.repeat(begins - (n[spelt].cumsum() - n[spelt]), n[spelt])
            ids[where + np.arange(len(where))] = np.concatenate(bytes_of)
        return ids, n


def uniform(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of key, place and salt."""
    with np.errstate(over="ignore"):
        x = place.astype(_U)
        x *= _U(64) * _STEP
        x += key + _U(salt) * _STEP
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def gumbel_below(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``phi``, truncated at ``bound``; -inf where phi is."""
    with np.errstate(divide="ignore"):
        g = phi - np.log(-np.log(u))
    return np.where(np.isneginf(phi), -np.inf, -np.logaddexp(-bound, -g))


@dataclass
class Paths:
    """A path of each text (none of some): where its edges begin, the edges and their texts, by text where they begin; what hangs on them."""

    slot: np.ndarray
    edge: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    log_p: np.ndarray
    before: np.ndarray  # log-probability of the path up to an edge
    value: np.ndarray  # perturbed value of the region beside an edge
    shut: dict[int, list[int]] = field(default_factory=dict)  # by number of an edge: where more than the path's own edge is excluded


class Search:
    """The search over the texts of one slice. A slot is a character; a path holds, at the slot where each of its edges begins, the edge."""

    def __init__(self, lattices: Lattices, units: np.ndarray, unit_doc: np.ndarray, keys: np.ndarray) -> None:
        self.l, self.n_docs, self.unit_doc = lattices, len(keys), unit_doc
        self.length = lattices.length[units]
        self.end = self.length.cumsum()
        self.slot = self.end - self.length  # of each unit
        self.place = lattices.start[units]
        self.slots = int(self.length.sum())
        per_doc = np.bincount(unit_doc, self.length, self.n_docs).astype(np.int64)
        self.doc_slot = np.concatenate([[0], per_doc.cumsum()])
        with np.errstate(over="ignore"):  # with these, numbers of a slot are those of its text's key and its place in the text
            self.keys = keys - self.doc_slot[:-1].astype(_U) * _U(64) * _STEP

    def walk(self, path: np.ndarray, slot: np.ndarray, place: np.ndarray, unit: np.ndarray, sample: int) -> None:
        """Draws edges from each of the given slots to the end of its unit."""
        l = self.l
        end, key = self.end[unit], self.keys[self.unit_doc[unit]]
        while len(slot):
            u = uniform(key, slot, 2 * sample)
            e = l.first[place]
            on = np.flatnonzero(l.upto[e] < u)
            while len(on):  # running probabilities end with 1
                further = e[on] + 1
                e[on] = further
                on = on[l.upto[further] < u[on]]
            path[slot] = e
            n = l.edge_length[e]
            slot, place = slot + n, place + n
            on = np.flatnonzero(slot < end)
            slot, place, end, key = slot[on], place[on], end[on], key[on]

    def regions(self, path: np.ndarray, since: np.ndarray, bound: np.ndarray, sample: int) -> Paths:
        """The paths, with the perturbed value of the region beside each edge from slot ``since`` (by doc) on."""
        slot = np.flatnonzero(path >= 0)
        edge = path[slot]
        bounds = np.searchsorted(slot, self.doc_slot)
        doc = np.repeat(np.arange(self.n_docs), np.diff(bounds))
        log_p = self.l.log_p[edge]
        run = np.concatenate([[0.0], log_p.cumsum()])
        before = run[:-1] - run[bounds[doc]]
        value = np.full(len(slot), -np.inf)
        rest = -np.expm1(log_p)
        at = np.flatnonzero((rest > 1e-12) & (slot >= since[doc]))
        mine = doc[at]
        value[at] = gumbel_below(before[at] + np.log(rest[at]), bound[mine], uniform(self.keys[mine], slot[at], 2 * sample + 1))
        return Paths(slot, edge, doc, bounds, log_p, before, value)

    def run(self, samples: int) -> tuple[list[Paths], list[np.ndarray], np.ndarray]:
        """Paths, their docs' masks, and the perturbed value of the best path that is not among them (-inf: there is none)."""
        l = self.l
        first = np.full(self.slots, -1, np.int64)
        self.walk(first, self.slot, self.place, np.arange(len(self.slot)), 0)
        with np.errstate(divide="ignore"):
            g = -np.log(-np.log(uniform(self.keys, self.doc_slot[:-1], 62)))
        paths, alive = [self.regions(first, self.doc_slot[:-1], g, 0)], [np.ones(self.n_docs, bool)]
        while True:
            best = np.full((len(paths), self.n_docs), -np.inf)
            for j, path in enumerate(paths):
                have = np.flatnonzero(np.diff(path.bounds))
                if len(have):
                    best[j, have] = np.maximum.reduceat(path.value, path.bounds[have])
            top = best.max(0)
            if len(paths) == samples:
                return paths, alive, top
            source = best.argmax(0)
            s = len(paths)
            new, since, open_ = np.full(self.slots, -1, np.int64), self.doc_slot[1:].copy(), np.isfinite(top)
            starts, places, units = [], [], []
            for j, path in enumerate(paths):
                mine = open_ & (source == j)
                if not mine.any():
                    continue
                hits = np.flatnonzero((path.value == top[path.doc]) & mine[path.doc])
                hits = hits[np.unique(path.doc[hits], return_index=True)[1]]
                slot, old, doc = path.slot[hits], path.edge[hits], path.doc[hits]
                since[doc] = slot
                copied = np.flatnonzero(mine[path.doc] & (path.slot < since[path.doc]))
                new[path.slot[copied]] = path.edge[copied]
                unit = np.searchsorted(self.slot, slot, side="right") - 1
                place = self.place[unit] + slot - self.slot[unit]
                n = l.count[place].astype(np.int64)
                width = np.arange(int(n.max()))
                edges = l.first[place][:, None] + width
                p = np.where(width < n[:, None], np.exp(l.log_p[np.minimum(edges, l.edges - 1)]), 0.0)
                p[np.arange(len(hits)), old - l.first[place]] = 0
                for i, h in enumerate(hits.tolist()):
                    for e in path.shut.get(h, ()):
                        p[i, e - l.first[place[i]]] = 0
                total = p.sum(1)
                u = uniform(self.keys[doc], slot, 2 * s + 20) * total
                pick = np.minimum((p.cumsum(1) <= u[:, None]).sum(1), n - 1)
                pick = np.where(p[np.arange(len(hits)), pick] > 0, pick, p.argmax(1))
                chosen = edges[np.arange(len(hits)), pick]
                new[slot] = chosen
                rest = total - p[np.arange(len(hits)), pick]
                with np.errstate(divide="ignore"):
                    phi = np.where(rest > 1e-12, path.before[hits] + np.log(np.maximum(rest, 1e-300)), -np.inf)
                path.value[hits] = gumbel_below(phi, top[doc], uniform(self.keys[doc], slot, 2 * s + 21))
                for h, e in zip(hits.tolist(), chosen.tolist(), strict=True):
                    path.shut.setdefault(h, []).append(e)
                go = slot + l.edge_length[chosen]
                on = go < self.end[unit]
                starts.append(go[on])
                places.append((place + l.edge_length[chosen])[on])
                units.append(unit[on])
            later = np.flatnonzero(self.slot > since[self.unit_doc])
            starts.append(self.slot[later])
            places.append(self.place[later])
            units.append(later)
            self.walk(new, *(np.concatenate(x) for x in (starts, places, units)), s)
            # the edge at ``since`` has its rest in the region it came from; regions of the new path lie behind it
            paths.append(self.regions(new, since + 1, top, s))
            alive.append(open_)


def sample_texts(lattices: Lattices, texts: pa.Array | list[str], keys: np.ndarray, samples: int) -> dict[str, np.ndarray]:
    """Columns doc (number of the text), sample, log_p, inclusion, and ids with their offsets."""
    units, which, unit_doc = units_of(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    paths, alive, rest = Search(lattices, lattices.of(units)[which], unit_doc, keys).run(samples)
    out = {"doc": [], "sample": [], "log_p": [], "inclusion": [], "ids": [], "n": []}
    for s, (path, on) in enumerate(zip(paths, alive, strict=True)):
        log_p = np.bincount(path.doc, path.log_p, len(texts)).astype(np.float64)  # whole numbers where no text has an edge
        ids, n = lattices.ids(path.edge)
        docs = np.flatnonzero(on)
        out["doc"].append(docs)
        out["sample"].append(np.full(len(docs), s))
        out["log_p"].append(log_p[docs])
        with np.errstate(over="ignore"):
            out["inclusion"].append(-np.expm1(-np.exp(log_p[docs] - rest[docs])))
        out["ids"].append(ids)
        out["n"].append(np.bincount(path.doc, n, len(texts)).astype(np.int64)[docs])
    return {k: np.concatenate(v) for k, v in out.items()}


def encode_samples(docs: DataFrame, samples: int = SAMPLES, alpha: float = ALPHA, model: str = MODEL, seed: int = 11, key: tuple[str, ...] = ("doc_id",), slice_chars: int | None = None, kept_edges: int | None = None) -> DataFrame:
    """Rows (doc_id, sample, ids, n_ids, log_p, inclusion): up to ``samples`` distinct segmentations of every row of ``docs``.

    Only text and the columns of ``key`` are read, which stand in the result in the place of doc_id. A piece's probability follows Zipf's law over the vocabulary's order, to the power alpha;
    log_p is a segmentation's log-probability among all of its text, and inclusion = 1 - exp(-exp(log_p - k)) the probability
    with which it is among the samples given k, the perturbed value of the best segmentation that is not (1 where all are).
    Sample 0 is a plain draw. Characters that are no piece are written as their bytes, so :func:`decode_ids` gives the text
    back. A null text counts as empty; an empty text has one segmentation, of no ids. The seed of a row is its key, so rows
    that agree in key and text get the same samples. Texts of any length are searched whole; short ones some at a time, so that
    a task's memory goes with slice_chars and kept_edges (by default SLICE and KEPT_EDGES) and its longest text; the more of both, the fewer lattices are built again.
    """
    vocabulary = Vocabulary.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary, alpha, kept_edges)
        for batch in batches:
            column, keys = batch.column("text"), batch.column("key").to_numpy().view(_U)
            ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (slice_chars or SLICE), side="right")))
                got = sample_texts(lattices, column.slice(at, to - at), keys[at:to], samples)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], got["n"].cumsum()]), pa.int32()), pa.array(got["ids"], pa.int32()))
                row = pa.array(at + got["doc"])
                columns = [*(batch.column(k).take(row) for k in key), pa.array(got["sample"], pa.int32()), ids, pa.array(got["n"], pa.int64()), pa.array(got["log_p"]), pa.array(got["inclusion"])]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "sample", "ids", "n_ids", "log_p", "inclusion"])
                at = to

    keyed = docs.select(*key, empty_if_null("text").alias("text"), F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in key]).alias("key"))
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key)
    return keyed.mapInArrow(run, f"{kinds}, sample int, ids array<int>, n_ids long, log_p double, inclusion double")


def encode_repeated(docs: DataFrame, samples: int = SAMPLES, **options) -> DataFrame:
    """Like :func:`encode_samples` for ``docs`` that repeat rows: adds ``repetition`` (from 0) of a doc_id and text, each with draws of its own.

    Repetitions are counted before the shuffle, so a row that is repeated often is sent once a task. Rows repeat if they agree in
    doc_id and text, null and empty texts being one; null doc_ids stay. Other columns are ignored. An empty table gives no rows.
    """
    times = docs.groupBy("doc_id", empty_if_null("text").alias("text")).agg(F.count("*").cast("int").alias("n"))
    return encode_samples(times.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("repetition")), samples, key=("doc_id", "repetition"), **options)


def decode_ids(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``text``, what their ids spell (replacing such a column); null ids spell null, special ids nothing."""
    vocabulary = Vocabulary.load(model)
    byte_of = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    spelt = [byte_of.get(i) or (b"" if i in vocabulary.special else p.replace(SPACE, " ").encode()) for i, p in enumerate(vocabulary.pieces)]

    @F.pandas_udf("string")
    def decode(column):  # noqa: ANN001, ANN202
        return column.map(lambda x: None if x is None else b"".join([spelt[i] for i in x]).decode("utf-8", "replace")[1:])

    return rows.withColumn("text", decode(F.col(ids)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document."""
    return encode_samples(read(spark, sf_dir, "documents").select("doc_id", "text"), slice_chars=2 * SLICE, kept_edges=6 * KEPT_EDGES)

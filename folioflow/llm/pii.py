"""Personal data by bootstrapped contextual extraction.

Base rules find emails, addresses, cards and phones: the seed entities. What stands around a seed, one to three tokens to its
left and one or two to its right, induces lexical patterns. Secrets have shapes of well-known keys as seeds, and a few contexts
that are patterns from the start. Every string that looks like an identifier at all (see :func:`candidates`), of any length, may
stand in a pattern's slot; signs that part strings belong to the context, so labels that are glued to a value are seen. Patterns and instances form a graph
that Spark scores in rounds until it stands still: a pattern is as good as the share of its occurrences in the corpus that hold
confident instances, an instance as good as the places it stands in. Instances that become confident induce further patterns
in the next round; what is confident at the end is personal data that no base rule knows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import empty_if_null, forget, materialize, read

#: Kinds of spans. The base rules know the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Grams that are counted in the corpus are told from others by so many bits, then exactly.
LG_BITS = 22
#: Rounds at most; the graph mostly stands still after three or four.
ROUNDS = 10
#: Tokens to the left and right that a pattern may have, and characters beside a span that are looked at for them.
LEFT, RIGHT, BESIDE = 3, 2, 60
#: A longer string is told from others by its digest.
LONG = 256

# The base rules. Domains are looked for at each "@", and the local part to the left of it; this finds what
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ finds, in linear time on long runs of letters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Words before a colon or an equals sign that announce a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")

# Shapes of well-known keys.
SHAPE_STARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
SHAPE = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)")

#: Characters of strings: all but white space and signs that part a value from its label or from others. A string with a digit,
#: an underscore or an "@" may be an identifier, and so may any of six characters or more right behind a colon or an equals sign.
_IN = r"[^\s=:,;\"'`(){}\[\]<>&|"
MARKED = re.compile(rf"(?<!{_IN}]){_IN}0-9@_]*+[0-9@_]{_IN}]*+")
LABELLED = re.compile(rf"(?<=[=:])[\"'` \t]{{0,3}}+({_IN}]{{6,}}+)")
#: A bracketed "at" or "dot" ties its neighbours together, and so does a space, with or without a bracket, between two strings with digits.
GLUED = re.compile(rf"({_IN}]++) ?[\[(](?:at|dot)[\])] ?({_IN}]++)")
TIES = (" ", ") ", ")")
#: A token of a context: a word, or a sign that is no quotation mark.
TOKEN = re.compile(r"\w+|[^\w\s\"'`]")

GRAM = pa.struct([("side", pa.string()), ("gram", pa.string())])
SPOT = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("norm", pa.string()), ("patterns", pa.list_(GRAM))])
SPOT_DDL = "array<struct<kind:int,start:int,end:int,norm:string,patterns:array<struct<side:string,gram:string>>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _addresses(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            out.append((start, last))
    return out


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base match: kind by place in KINDS, code points, end exclusive, by kind, then start."""
    out = [(0, *span) for span in _addresses(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((3, *m.span()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every string that may be an identifier, in order and apart from each other; signs at its ends are left out."""
    found = {m.span() for m in MARKED.finditer(text)}
    found |= {m.span(1) for m in LABELLED.finditer(text)}
    if "(" in text or "[" in text:
        at = 0
        while m := GLUED.search(text, at):
            found.add(m.span())
            at = m.start(2)  # a chain goes on with what was tied
    runs: list[list[int]] = []
    for start, end in sorted(found):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
            continue
        gap = text[runs[-1][1] : start] if runs and start - runs[-1][1] <= 2 else None
        if gap in TIES and text[runs[-1][1] - 1].isalnum() and DIGIT.search(text, *runs[-1]) and DIGIT.search(text, start, end):
            if gap != " ":
                runs[-1][0] -= text[runs[-1][0] - 1 : runs[-1][0]] == "("
            runs[-1][1] = end
        else:
            runs.append([start, end])
    out = []
    for start, end in runs:
        while start < end and not text[start].isalnum() and not (text[start] == "(" and ")" in text[start:end]) and text[start] != "+":
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start >= 3:
            out.append((start, end))
    return out


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(left: str, right: str) -> list[dict]:
    """The patterns of a place from what stands to its left and right."""
    ahead, behind = tokens(left), tokens(right)
    out = [{"side": "l", "gram": " ".join(ahead[-n:])} for n in range(1, LEFT + 1) if len(ahead) >= n]
    return out + [{"side": "r", "gram": " ".join(behind[:n])} for n in range(1, RIGHT + 1) if len(behind) >= n]


def spots(text: str | None) -> list[dict]:
    """Base spans, keys of known shape and, under kind -1, the candidates that touch none, with the patterns they stand in; by kind, then start."""
    if not text:
        return []
    known = base_spans(text)
    if any(s in text for s in SHAPE_STARTS):
        known += [(KINDS.index("secret"), *m.span()) for m in SHAPE.finditer(text)]
    taken, at, free, reach = sorted(x[1:] for x in known), 0, [], 0
    for start, end in candidates(text):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            free.append((-1, start, end))
    out = []
    for kind, start, end in free + known:
        norm = _digits(text[start:end]) if kind in (2, 3) else text[start:end].lower()
        norm = hashlib.sha256(norm.encode()).hexdigest() if len(norm) > LONG else norm
        out.append({"kind": kind, "start": start, "end": end, "norm": norm, "patterns": grams(text[max(0, start - BESIDE) : start], text[end : end + BESIDE])})
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([spots(t.as_py()) for t in batch.column(1)], type=pa.list_(SPOT))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "found"])


def seed_patterns(spark: SparkSession) -> DataFrame:
    """Contexts that are patterns of secrets from the start: (kind, side, gram, conf)."""
    rows = [(KINDS.index("secret"), "l", f"{w} {sign}", 0.95) for w in SECRET_WORDS for sign in "=:"]
    return spark.createDataFrame(rows, "kind int, side string, gram string, conf double")


def occurrences(spots_: DataFrame) -> DataFrame:
    """Instances and places: (kind, norm, place, patterns, n), one row per instance and surrounding, n times in the corpus."""
    return spots_.groupBy("kind", "norm", "patterns").agg(F.count("*").alias("n")).withColumn("place", F.xxhash64("patterns"))


def _bits(grams_: DataFrame) -> bytes:
    """A bit set of the checksums of ``grams_`` (gram), of the same size however many there are."""
    at = F.crc32("gram") % (1 << LG_BITS)
    rows = grams_.select(F.shiftright(at, 15).alias("part"), (at % (1 << 15)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray(1 << (LG_BITS - 3))
    for r in rows:
        out[r.part << 12 : (r.part + 1) << 12] = r.bits
    return bytes(out)


def corpus_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each of ``wanted`` (gram, different ones) stands in the texts of ``docs``, whatever follows: (gram, total).

    Tasks count what may be wanted by a bit set, and only that meets the wanted grams themselves.
    """
    whole = _bits(wanted)
    begins, begins2 = (_bits(wanted.where(F.size(F.split("gram", " ")) > n).select(F.substring_index("gram", " ", n).alias("gram"))) for n in (1, 2))

    def at(gram: str) -> tuple[int, int]:
        crc = zlib.crc32(gram.encode()) % (1 << LG_BITS)
        return crc >> 3, 1 << (crc & 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, first = {}, {}  # what the sets say of tokens met so far
        for batch in batches:
            total: Counter[str] = Counter()
            for text in batch.column("text"):
                w = tokens(text.as_py() or "")
                if len(kept) > 1 << 18:
                    kept, first = {}, {}
                for token, n in Counter(w).items():
                    if token not in kept:
                        byte, bit = at(token)
                        kept[token], first[token] = whole[byte] & bit, begins[byte] & bit
                    if kept[token]:
                        total[token] += n
                for i, token in enumerate(w[:-1]):
                    if first[token]:
                        gram = f"{token} {w[i + 1]}"
                        byte, bit = at(gram)
                        if whole[byte] & bit:
                            total[gram] += 1
                        if begins2[byte] & bit and i + 2 < len(w):
                            gram = f"{gram} {w[i + 2]}"
                            byte, bit = at(gram)
                            if whole[byte] & bit:
                                total[gram] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    each = docs.select("text").mapInArrow(run, "gram string, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("total")).join(wanted.select("gram"), "gram")


def score_graph(found: DataFrame, totals: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, min_support: int = 3, min_score: float = 0.8, prior: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Scores the graph of ``found`` (see :func:`occurrences`): patterns (kind, side, gram, conf) and, of those that are no base
    matches, instances (norm, kind, score).

    conf = sum over a pattern's places of n x score of the instance there / (total + prior), for patterns that at least
    min_support different confident instances stand in; ``seeds`` are patterns whatever their places hold. A place is as sure
    as 1 - (1 - l)(1 - r), l and r the best of its patterns on each side; an instance scores the mean of its places, for the
    kind with the largest mean, where places that no pattern knows say nothing. Rounds end when the confident instances stay the same, or after ``rounds``.
    """
    loose = found.where("kind < 0")
    spread = loose.select("norm", "place", "n", F.explode("patterns").alias("p")).select("norm", "place", "n", "p.side", "p.gram")
    scores = materialize(loose.limit(0).select("norm", "kind", F.lit(0.0).alias("score")), "pii-scores")
    patterns, before = None, None
    for _ in range(rounds):
        good = scores.where(F.col("score") >= min_score)
        held = found.where("kind >= 0").select("kind", "norm", "patterns", "n", F.lit(1.0).alias("score"))
        held = held.unionByName(loose.drop("kind").join(good, "norm").select("kind", "norm", "patterns", "n", "score"))
        by = held.select("kind", "norm", "n", "score", F.explode("patterns").alias("p")).groupBy("kind", "p.side", "p.gram", "norm").agg(F.sum(F.col("n") * F.col("score")).alias("mass"))
        learnt = by.groupBy("kind", "side", "gram").agg(F.sum("mass").alias("mass"), F.count("*").alias("support")).where(F.col("support") >= min_support)
        learnt = learnt.join(totals, "gram").select("kind", "side", "gram", F.least(F.lit(0.99), F.col("mass") / (F.col("total") + prior)).alias("conf"))
        now = materialize(learnt.unionByName(seeds).groupBy("kind", "side", "gram").agg(F.max("conf").alias("conf")), "pii-patterns")
        sure = spread.join(now, ["side", "gram"]).groupBy("norm", "place", "n", "kind").agg(*[F.max(F.when(F.col("side") == s, F.col("conf")).otherwise(0.0)).alias(s) for s in "lr"])
        place = 1 - (1 - F.col("l")) * (1 - F.col("r"))
        mass = sure.select("norm", "place", "n").distinct().groupBy("norm").agg(F.sum("n").alias("mass"))
        kinds = sure.groupBy("norm", "kind").agg(F.sum(F.col("n") * place).alias("s"))
        best = kinds.groupBy("norm").agg(F.max(F.struct("s", (-F.col("kind")).alias("k"))).alias("b"))
        new = materialize(best.join(mass, "norm").select("norm", (-F.col("b.k")).alias("kind"), (F.col("b.s") / F.col("mass")).alias("score")), "pii-scores")
        for old in (scores, *([patterns] if patterns is not None else [])):
            forget(old)
        scores, patterns = new, now
        state = scores.where(F.col("score") >= min_score).agg(F.count("*"), F.sum(F.xxhash64("norm", "kind").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return patterns, scores


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_support: int = 3, min_score: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id and ``found``, an array of (kind, start, end, base).

    Spans are in code points with their end excluded, by kind in the order of KINDS, then start; ``base`` tells matches of the
    four base rules from keys of known shape and what patterns added, which never overlap a known span. A null text counts as empty; an empty one has no
    spans; repeated rows fare alike; null doc_ids stay. Texts are read twice (scan, corpus counts) and never shuffled. An
    instance is confirmed by the whole corpus and then marked wherever it stands.
    """
    seen = docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {SPOT_DDL}")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    each = seen.select("row", F.explode("found").alias("o")).select("row", "o.*")
    found = materialize(occurrences(each), "pii-places")
    seeds = seed_patterns(docs.sparkSession)
    out, added = seen, F.lit(None).cast(SPOT_DDL)
    if not found.where("kind < 0").isEmpty():  # else there is nothing to discover
        # a pattern needs several instances, so only what stands beside that many is counted in the corpus
        beside = found.select("norm", F.explode("patterns.gram").alias("gram")).distinct().groupBy("gram").agg(F.count("*").alias("norms"))
        beside = materialize(beside.where(F.col("norms") >= min_support).select("gram"), "pii-beside")
        totals = materialize(corpus_counts(docs, beside), "pii-totals")
        _, scores = score_graph(found, totals, seeds, rounds, min_support, min_score)
        for done in (found, beside, totals):
            forget(done)
        sure = scores.where(F.col("score") >= min_score).select("norm", F.col("kind").alias("as"))
        new = each.where("kind < 0").join(sure, "norm").groupBy("row").agg(F.collect_list(F.struct(F.col("as").alias("kind"), "start", "end", "norm", "patterns")).alias("added"))
        out, added = seen.join(new, "row", "left"), F.col("added")

    def plain(spans: Column, known: bool) -> Column:
        return F.transform(spans, lambda o: F.struct(o.kind.alias("kind"), o.start.alias("start"), o.end.alias("end"), ((o.kind < len(BASE_KINDS)) & F.lit(known)).alias("base")))

    known = plain(F.filter("found", lambda o: o.kind >= 0), True)
    return out.select("doc_id", F.array_sort(F.concat(known, plain(F.coalesce(added, F.array().cast(SPOT_DDL)), False))).alias("found"))


def of_kind(spans: Column, kind: int) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda s: s.kind == kind)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base matches counted and digested, and all spans spelt out.

    ``spans`` has all spans of all kinds, those that were discovered too; n_added counts what no base rule finds.
    """
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", empty_if_null("text").alias("text")))
    base, secret = F.filter("found", lambda s: s.base), of_kind(F.col("found"), KINDS.index("secret"))
    counts = [F.size(of_kind(base, k)).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        F.size(secret).cast("long").alias("n_secret"),
        (F.size("found") - F.size(base)).cast("long").alias("n_added"),
    )

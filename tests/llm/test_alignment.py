import hashlib
import random
from collections import Counter

import pytest

from folioflow.llm import alignment as al

FILES = (f"{al.TOKENIZERS}/{al.FILE_A}", f"{al.TOKENIZERS}/{al.FILE_B}")


@pytest.fixture(scope="module")
def tok():
    return al.Tokens(*FILES)


def whole(tok, text):
    """Tokens of the text in one go, as (id, start, end), or None."""
    if not text:
        return None
    out = []
    for ids, spelt in ((tok.a.encode(" " + text, add_special_tokens=False).ids, tok.bytes_a), (tok.b.encode(text), tok.bytes_b)):
        at, side = 0, []
        for i in ids:
            side.append((i, at, at + len(spelt[i])))
            at += len(spelt[i])
        if b"".join(spelt[i] for i in ids) != (" " + text).encode():
            return None
        out.append(side)
    return out


def brute(tok, rows):
    """What must come out for (doc_id, text) rows: pairs of tokens are compared one by one."""
    found, links = {}, {}
    for key, (_, text) in enumerate(rows):
        both = whole(tok, text)
        if both:
            a, b = both
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            spelt, at = [], [0, 0]
            for c in cuts:
                ids = [[], []]
                for k, side in enumerate(both):
                    while at[k] < len(side) and side[at[k]][2] <= c:
                        ids[k].append(str(side[at[k]][0]))
                        at[k] += 1
                spelt.append("|".join(map(",".join, ids)))
            found[key] = (len(a), len(b), len(cuts), hashlib.sha256(";".join(spelt).encode()).hexdigest())
            near = 0
            links[key] = []
            for i, s, e in a:
                while near < len(b) and b[near][2] <= s:
                    near += 1
                j = near
                while j < len(b) and b[j][1] < e:
                    links[key].append((i, b[j][0]))
                    j += 1
    count = Counter(p for ls in links.values() for p in ls)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, (doc_id, _) in enumerate(rows):
        if key in found:
            ls = links[key]
            out.append((doc_id, *found[key][:3], len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), found[key][3]))
        else:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "Haus", "forêt", "niño", "1234567", "don't", "\n", "\t", " ", "x", "東京都", "🎉👍🏽", "ﬁne", "a-b_c", "<s>", "<|endoftext|>", "</s>", "<0x41>", " ", " ", "᠎", "\x00", "\r\n", "\x1c", "internationalization", "zzzzzzzzzzzzz", "...", "'s", "'", "é"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


ODD = [None, "", " ", "  ", "a", "\n", "▁", "a▁ b", "x ▁y", "<unk>", "one two", "one two", "one  two ", " one"]


def test_stretches_give_the_tokens_of_whole_texts(tok):
    cases = [t for t in texts(400, 1) + ODD if t]
    for text, got in zip(cases, tok.encode(cases)):
        want = whole(tok, text)
        assert (got is None) == (want is None), text
        if want:
            ids = [al.np.frombuffer(x, d).tolist() for x, d in zip(got, tok.dtypes)]
            assert ids == [[i for i, _, _ in side] for side in want], text
        assert " ".join(tok.stretches(text)) == text


def test_query_against_brute_force(spark, tok, monkeypatch):
    rows = list(enumerate(texts(60, 2) + ODD)) + [(7, "again and again"), (7, "again and again"), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n_a int, row string")
    want = brute(tok, rows)
    assert sorted(map(tuple, al.alignment_stats(docs, FILES).collect()), key=repr) == want
    monkeypatch.setattr(al, "WINDOW", 7)  # windows and blocks that end inside words and documents
    monkeypatch.setattr(al, "BLOCK_LINKS", 50)
    monkeypatch.setattr(al, "REMEMBERED", 20)
    events = al.end_events(al._numbered(docs), FILES)
    al.materialize(events, "events")
    assert sorted(map(tuple, al.alignment_stats(docs.repartition(3), FILES).collect()), key=repr) == want


def test_small_windows_change_nothing(tok, monkeypatch):
    """The state machine by itself: events cut at any byte give the same groups and links."""
    rng = random.Random(3)
    for text in texts(60, 4):
        both = whole(tok, text)
        if not both:
            continue
        got = []
        for width in (3, 11, 1 << 20):
            sweep, runs = al.Sweep(1, 1, tok), []
            for w in range(0, both[0][-1][2], width):
                for side in (0, 1) if rng.random() < 0.5 else (1, 0):
                    ids = [i for i, _, e in both[side] if w < e <= w + width]
                    sweep.take(side, al.np.array(ids, tok.dtypes[side]).tobytes())
                run = sweep.close(w + width >= both[0][-1][2])
                runs += [run] if run else []
            groups = [(r.start, r.ends.tolist(), r.in_a.tolist(), r.in_b.tolist()) for r in runs if len(r.a)]
            got.append((sum((r.a.tolist() for r in runs), []), [e for g in groups for e in g[1]], [n for g in groups for n in g[2]], [n for g in groups for n in g[3]], sorted(p for r in runs for p in zip(r.link_a.tolist(), r.link_b.tolist()))))
        assert got[0] == got[1] == got[2]


def test_groups_spell_the_text(spark, tok):
    rows = [(1, "Das Schloß steht, 東京 nicht."), (2, None), (3, "▁"), (None, "x"), (4, "y"), (4, "y")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, start string")
    groups = sorted(al.align(docs, FILES).collect(), key=lambda g: (g.row, g.start))
    by_row = {}
    for g in groups:
        assert b"".join(tok.bytes_a[i] for i in g.a) == b"".join(tok.bytes_b[i] for i in g.b) and g.end - g.start == sum(len(tok.bytes_a[i]) for i in g.a)
        by_row.setdefault((g.row, g.doc_id), []).extend(g.a)
    assert sorted((i, b"".join(tok.bytes_a[x] for x in ids).decode()[1:]) for (_, i), ids in by_row.items() if i is not None) == [(1, rows[0][1]), (4, "y"), (4, "y")]
    assert [i for _, i in by_row if i is None] == [None]


def test_very_long_text_and_empty_table(spark, tok):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60_000)) + "q" * 5_000
    rows = [(1, long), (2, "b" * 3_000), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, al.alignment_stats(docs, FILES).collect())) == brute(tok, rows)
    assert al.alignment_stats(docs.limit(0), FILES).collect() == []
    assert al.align(docs.limit(0), FILES).collect() == []

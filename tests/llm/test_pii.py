import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, found string, kind int"


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def brute(text):
    """The base rules as they are stated, by plain regular expressions."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@-+_%é 0129()\n", max_size=60))
def test_base_rules_on_random_texts(text):
    assert pii.base_spans(text) == brute(text)


def test_base_rules_on_chosen_texts():
    for text in ["a@b.c@d.e", "@b.c@d.e", "x@y", "é.a@b.co.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "++1 555 555 0100+", "12345678901234567890", "", "😀 a@b.cd"]:
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


def test_documents_against_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found if s.base] for r in pii.find_pii(docs).collect()}
    assert found == {i: brute(t or "") for i, t in texts.items()}
    assert any(found.values())


def test_query_counts_and_digest_against_the_rules(spark):
    """Every column of the query over a whole table, the graph's decisions among them."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = graph([t for t in docs.values()])
    rows = pii.op1_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in range(4))
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        added = [(known[s["norm"]], s["start"], s["end"]) for s in pii.spots(docs[r.doc_id]) if s["kind"] < 0 and s["norm"] in known]
        every = sorted(base + added)
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in every)
        assert r.n_added == len(added) and r.n_secret == sum(k == 4 for k, _, _ in added)
    assert sum(r.n_added for r in rows) > 0


def words(text):
    return re.findall(r"\w+|[^\w\s\"'`]", text.lower())


def patterns_of(spot):
    return [(p["side"], p["gram"]) for p in spot["patterns"]]


def graph(texts, rounds=pii.ROUNDS, min_support=3, min_score=0.8, prior=1.0):
    """The pattern-instance graph scored by plain loops: the kind of each confident instance that no base rule finds."""
    spots = [s for t in texts for s in pii.spots(t)]
    totals = Counter()
    for t in texts:
        w = words(t)
        totals.update(" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, max(pii.LEFT, pii.RIGHT) + 1) if i + n <= len(w))
    seeds = {(4, "l", f"{w} {c}"): 0.95 for w in pii.SECRET_WORDS for c in "=:"}
    sure = {}
    for _ in range(rounds):
        mass, who = defaultdict(float), defaultdict(set)
        for s in spots:
            kind, score = (s["kind"], 1.0) if s["kind"] >= 0 else sure.get(s["norm"], (None, 0))
            if kind is not None:
                for p in patterns_of(s):
                    mass[kind, *p] += score
                    who[kind, *p].add(s["norm"])
        conf = {p: min(0.99, m / (totals[p[2]] + prior)) for p, m in mass.items() if len(who[p]) >= min_support and totals[p[2]]}
        conf = {p: max(conf.get(p, 0), seeds.get(p, 0)) for p in conf.keys() | seeds.keys()}
        got, n = defaultdict(float), Counter()
        for s in spots:
            if s["kind"] < 0:
                places = patterns_of(s)
                n[s["norm"]] += any((kind, *p) in conf for kind in range(5) for p in places)
                for kind in range(5):
                    best = {side: max([conf.get((kind, *p), 0) for p in places if p[0] == side], default=0) for side in "lr"}
                    got[s["norm"], kind] += 1 - (1 - best["l"]) * (1 - best["r"])
        new = {}
        for norm, c in n.items():
            kind = max(range(5), key=lambda k: (got[norm, k], -k))
            if c and got[norm, kind] / c >= min_score:
                new[norm] = (kind, got[norm, kind] / c)
        if new.keys() == sure.keys():
            break
        sure = new
    return {k: v[0] for k, v in sure.items()}


def discovered(spark, rows):
    out = {}
    for r in pii.find_pii(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end, s.base) for s in r.found])
    return out


def test_patterns_discover_what_no_rule_knows(spark):
    rows = [(i, f"words here, reach me at: +1 (555) 555-01{i:02d} extension; mail-to: user{i}@host.example.com please", "x", 1) for i in range(30)]
    rows += [(100, "call, reach me at: 555-555-0199 extension now", "x", 1), (101, "write mail-to: someone@intranet please", "x", 1), (102, "part 555-555-0198 of 100", "x", 1), (103, "nobody@nowhere is here", "x", 1)]
    rows += [(104, None, "x", 1), (105, "", "x", 1), (None, "at: +1 (555) 555-0100 extension", "x", 1), (106, "plain", "x", 1), (106, "plain", "x", 1)]
    rows += [(107, "mail-to: jane (at) host (dot) example please", "x", 1), (108, "reach me at: (555) 0177 extension", "x", 1)]
    found = discovered(spark, rows)
    assert found[100] == [[(3, 19, 31, False)]] and found[101] == [[(0, 15, 31, False)]]
    assert found[102] == found[103] == found[104] == found[105] == [[]] and found[106] == [[], []]
    assert found[None] == [[(3, 4, 21, True)]]
    assert found[107] == [[(0, 9, 37, False)]] and found[108] == [[(3, 13, 23, False)]]


def test_discovered_instances_teach_further_patterns(spark):
    rows = [(i, f'api_key = "K{i}x{i * 77}Q" and then', "x", 1) for i in range(12)]
    rows += [(100 + i, f"vault entry: K{i}x{i * 77}Q stored", "x", 1) for i in range(12)]  # the same secrets elsewhere
    rows += [(200, "vault entry: Zeta_9 stored", "x", 1), (201, "vault of 1999 other goods", "x", 1)]
    found = discovered(spark, rows)
    assert all(found[i] == [[(4, 11, 11 + len(f"K{i}x{i * 77}Q"), False)]] for i in range(12))
    assert all(len(found[100 + i][0]) == 1 for i in range(12))
    assert found[200] == [[(4, 13, 19, False)]] and found[201] == [[]]  # a pattern that only the second round has
    one = {r.doc_id: r.found for r in pii.find_pii(spark.createDataFrame(rows, SCHEMA), rounds=1).collect()}
    assert one[200] == []
    known = graph([t for _, t, *_ in rows])
    assert "zeta_9" in known and "1999" not in known


def test_candidates_are_linear_and_apart():
    assert pii.candidates("a " * 10 + "9" * 300_000) == [(20, 300_020)] and pii.candidates("(" * 100_000 + "1") == []
    assert pii.candidates("x" * 300_000) == [] and pii.candidates("a@" * 100_000) == [(0, 199_999)]
    assert len(pii.candidates("(at)" * 50_000 + " a (dot) b" * 20_000)) == 20_000 and len(pii.candidates("a (dot) " * 20_000 + "b")) == 1
    text = 'x = "a1b2c3"### (555) 555-0100, 12 and __init__ b@c'
    assert [text[a:b] for a, b in pii.candidates(text)] == ["a1b2c3", "(555) 555-0100", "init", "b@c"]


def test_no_rows_and_clashing_columns(spark):
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).collect() == []


def test_glued_and_long_secrets(spark):
    """Values right behind their labels, without digits, and of any length."""
    long = "Qx" * 140
    shapes = [("cfg line password=", "Hunter3x{}Q", ""), ("API_KEY=", "sk{}45678", ""), ('{"token":"', "abcdefgh{}", '"}'), ('token = "', "abcdefgh", '" ok'), ("x;secret:", "Zz-{}.q/+7", ";y"), ('token = "', long, '"'), ("[passwd=", "plainword", "]")]
    rows, want = [], {}
    for i in range(70):
        before, value, after = shapes[i % len(shapes)]
        value = value.format(i)
        rows.append((i, f"{before}{value}{after}", "x", 1))
        want[i] = [(4, len(before), len(before) + len(value), False)]
    rows += [(200, "y" * 700 + ' token="' + "k" * 900 + '" ' + "z" * 5000 + "=1", "x", 1), (201, "the word after a colon: something else", "x", 1), (202, "a=b;" * 3000 + "password=Deep4secret", "x", 1)]
    rows += [(300 + i, f"remark {i}: common, words: follow{chr(97 + i % 26)}; colons: mostly", "x", 1) for i in range(60)]
    found = discovered(spark, rows)
    assert {i: found[i][0] for i in want} == want
    assert found[200] == [[(4, 708, 1608, False)]] and found[201] == [[]] and found[202] == [[(4, 12009, 12020, False)]]


def test_known_shapes_induce_contexts(spark):
    """Keys of known shape are seeds: what stands in their contexts is found too."""
    rows = [(i, f"deploy credential AKIA{'ABCDEFGHIJKLMNOP'[i:] + 'ABCDEFGHIJKLMNOP'[:i]} rotated", "x", 1) for i in range(8)]
    rows += [(50, "deploy credential Own_4711 rotated", "x", 1), (51, "their number 4711 here", "x", 1)]
    found = discovered(spark, rows)
    assert all(found[i] == [[(4, 18, 38, False)]] for i in range(8)) and found[50] == [[(4, 18, 26, False)]] and found[51] == [[]]

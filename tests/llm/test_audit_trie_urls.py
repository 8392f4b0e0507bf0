"""Source divergence, conversation trie and URL filters against brute force over odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import docs, odd_rows

from cairn.llm import divergence, trie, urls

# source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_divergence(rows):
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    found = [([lowered(m) for m in TERM.findall(t)], a, b) for t, a, b in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, source in found:
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {x[1] for x in found}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        p = lambda g: {t: 1 + 10**9 * (g[t] + 1) // (sum(g.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        q, shares = p(whole), {s: p(g) for s, g in groups.items()}
        for s, g in groups.items():
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if g[t] > 0 and shares[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1)}
    return out


def group_rows():
    rng = random.Random(2)
    common = [f"Wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)] + ["é", "ÉÀ", "x\u00a0y", "日本"]
    rows = []
    for k in range(140):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", None, "日", "Z"])
        rows.append((" ".join(rng.choice(common[: rng.choice([5, 60, 404])]) for _ in range(rng.randrange(0, 90))), lang, source))
    rows += [(t, "en", "odd") for _, t in odd_rows()]
    rows += [("rare words only here", "fr", "a"), (None, "fr", "b"), ("1 2 3", "xx", "alone"), ("Äa äa aA", "tt", "t")]
    return rows + rows[:20]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = group_rows()
    for held, slice_ in ((300_000, 1 << 18), (50, 40)):  # full dictionaries and many numbering windows
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SLICE", slice_)
        df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, bits int")
        got = divergence.audit(df.repartition(3)).collect()
        assert {tuple(r) for r in got} == brute_divergence(rows) and len(got) == len({tuple(r) for r in got})


def test_divergence_of_very_frequent_terms_is_exact(spark):
    n = spark.createDataFrame([(3 * 10**12, 10**13, 7)], "c long, n long, v long")
    got = n.select(divergence.share(n.c, n.n, n.v).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (3 * 10**12 + 1) // (10**13 + 7)


def test_divergence_of_empty_tables(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    one = divergence.audit(docs(spark, [(1, "a b c")]))
    assert one.count() == 0 and one.columns == ["lang", "source", "part", "item", "value", "rank"]


# conversation trie


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, token), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute_trie(rebuilt):
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    below = defaultdict(list)
    for seq in members:
        if seq:
            below[seq[:-1]].append(seq)
    out, totals = set(), {}
    for seq in sorted(members, key=len, reverse=True):
        own = (len(members[seq]) - 1) * len(word.findall(seq[-1][1])) if seq else 0
        leaves = sum(totals[x][0] for x in below[seq]) if below[seq] else 1
        totals[seq] = leaves, own + sum(totals[x][1] for x in below[seq])
        ends = ",".join(str(c) for c in sorted(members[seq]) if len(rebuilt[c]) == len(seq))
        parent = min(members[seq[:-1]]) if seq else None
        out.add((min(members[seq]), len(seq), parent, len(members[seq]), len(below[seq]), *totals[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, name string, depth int"


def conversations():
    rng = random.Random(9)
    say = lambda k: [f"first {k}", f"a  b\tc {k}", "", None, "x " * 400][k % 5]
    rows = []
    for c in range(160):
        if c % 37 == 5:
            continue
        length = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 40])
        start = rng.randrange(3)
        kind = rng.randrange(3)
        turns = [(c, start + t, rng.choice(["user", "user", None]), say(rng.randrange(5) if rng.random() < 0.15 else (t * 7 + kind) % 5)) for t in range(length)]
        rows += turns
    rows += [(c, t, "user", f"same {t}") for c in range(500, 580) for t in range(6)]  # many copies
    rows += [(700, None, "user", "null turn"), (700, 0, "user", "zero"), (700, 0, "user", "zero"), (700, 0, "user", "other"), (None, 1, "user", "none")]
    rows += [(21, t, "user", f"long {t % 3}") for t in range(10, 140)]
    rows += [(99_999_999_999, 0, "u", "far"), (-3, 0, "u", "negative"), (900, 1, None, None), (913, 0, "u", "a")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(4)
    rebuilt = brute_rebuilt([r for r in rows])
    assert any(not t for t in rebuilt.values()) and any(zlib.crc32(str(c).encode()) % 4 > len(t) for c, t in rebuilt.items())
    for piece in (4096, 7):
        monkeypatch.setattr(trie, "PIECE", piece)
        got = trie.forest(*trie.rebuilt(df))
        assert {t for _, t in got.dtypes} == {"bigint", "string"}
        found = [tuple(r) for r in got.collect()]
        assert set(found) == brute_trie(rebuilt) and len(found) == len(set(found))


@pytest.mark.parametrize("lengths", [[], [0], [0, 0], [1], [1, 1, 0], [2, 3], [8, 8, 8], [31, 32, 33, 64]])
def test_trie_of_any_depth(spark, lengths):
    seqs = {c: [("", f"t{d % 5} w") for d in range(n)] for c, n in enumerate(lengths)}
    rows = [(c, d, trie_token(x), len(x[1].split())) for c, s in seqs.items() for d, x in enumerate(s)]
    sequences = spark.createDataFrame(rows, "conv_id long, pos long, token binary, words int")
    sizes = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv_id long, length long")
    assert {tuple(r) for r in trie.forest(sequences, sizes).collect()} == brute_trie(seqs)


def trie_token(turn):
    return hashlib.sha256("|".join(turn).encode()).digest()[:16]


def test_trie_of_an_empty_table(spark):
    assert trie.forest(*trie.rebuilt(spark.createDataFrame([], CONVERSATIONS))).count() == 0


# URL filters


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = lowered(host)
    fit = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme.org/", "http://a.org", "http://a.org/", "HTTP://WWW.Example.ORG/es/x", "http://example.org/en/1",
    "http://badexample.org/es/", "http://x.example.org/en/12?q=http://com/fr/", "ftp://com/de/", "http://a.com/de", "s://org?x/y",
    "s://com:80/fr/", "://org/", "s://É.org/es/", "s://org./", "s://.org/", "s://a..com/fr/\nnext", "s://" + "a." * 300 + "com/fr/" + "é" * 5000,
    "s://org/#://com/de/", "s://t.io/aab", "s://t.io/aa", "s://T.IO/aaa", "s://x.t.io/a", "s://q.x.t.io/ab?aaa", "s:///only/path",
]


@pytest.mark.parametrize(
    "rules",
    [urls.RULES, [], [("t.io", "/aa", "block"), ("t.io", "/aa", "allow"), ("x.t.io", "/", "allow"), ("t.io", "/ab", "block"), ("", "", "block"), ("", "/o", "allow"), ("T.io", "/aaa", "allow")]],
)
def test_urls_equal_brute_force(spark, rules):
    rows = [(i, u, "rule", "x") for i, u in enumerate(URLS)] + [(3, URLS[3], None, None), (None, URLS[5], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, html string").repartition(3)
    made = spark.createDataFrame([*rules, *rules[:1]], "host string, path string, verdict string")
    got = sorted(map(str, [tuple(r) for r in urls.judge(pages, made).collect()]))
    lower = [(lowered(h), p, v) for h, p, v in rules]
    assert got == sorted(str((i, *brute_judge(u, lower))) for i, u, _, _ in rows)


def test_urls_with_null_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "s://a.b/c"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("b", None, None), (None, None, "allow")], "host string, path string, verdict string")
    assert sorted(tuple(r)[3:] for r in urls.judge(pages, rules).collect()) == [("", "allow"), ("b", "block")]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_urls_when_rules_are_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/', id % 900) AS url")
        rules = spark.range(2000).selectExpr("concat('h', id % 9, '.org') AS host", "concat('/', id % 500) AS path", "'block' AS verdict")
        got = urls.judge(pages, rules).filter("verdict = 'block'").count()
        want = [(h, p) for h, p in {(f"h{i % 9}.org", f"/{i % 500}") for i in range(2000)}]
        assert got == sum(any(f"h{i % 7}.org" == h and f"/{i % 900}".startswith(p) for h, p in want) for i in range(3000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""Ranked search, URL filters and spelling variants against plain Python twins."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import EDGE_ROWS, LONG, documents

from veilscan.llm import lexical, spelling, urls

# Ranked search.

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k=20):
    own = [(d, Counter(TERMS.findall(lower(t)))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    total, all_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        asked, scores = Counter(TERMS.findall(lower(text))), []
        for d, c, n in own:
            m = 100 - 25 + (25 * n * total) // all_terms
            score = sum(k * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS bundle", "2 AS item")


@pytest.mark.parametrize("postings, terms", [(200_000, 16_384), (40, 5)])
def test_ranked_search(spark, monkeypatch, postings, terms):
    monkeypatch.setattr(lexical, "SLICE_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BUNDLE_TERMS", terms)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcé日9", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(1, 40)))) for i in range(150)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1])] + [(r[0], r[1]) for r in EDGE_ROWS]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(3, "the FOX, the quick fox!"), (items[0]), (100, None), (101, ""), (102, "no-such-thing"), (None, "fox end naïve"), (103, LONG)]
    docs = documents(spark, [(d, t, None) for d, t in rows])
    got = lexical.top_k(docs, items_frame(spark, items), k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(rows, items, k=5)


def test_ranked_search_of_nothing(spark):
    nothing, one = [(1, None), (2, " .")], [(1, "fox")]
    for rows, items in ((nothing, one), (one, nothing), ([], one), (one, []), (one, [(1, "dog")])):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert lexical.top_k(docs, items_frame(spark, items)).collect() == []


def test_long_texts_are_cut_between_terms():
    text = ("word " * 300_000 + "x" * 2_000_000 + " end").encode()
    assert b"".join(lexical.parts(text)) == text
    n, sizes, terms, times = lexical.counts_of_long(text, None)
    assert n.tolist() == [300_002] and dict(zip(terms.to_pylist(), times.tolist())) == {b"word": 300_000, b"x" * 2_000_000: 1, b"end": 1}


# URL filters.


def url_verdicts(pages, rules, labels, f):
    """[(page, host, path, rule, verdict)] with a tree built by recursion."""

    def located(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (lower(m[1]), m[2]) if m else ("", "")

    def ruled(host, path):
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    counts = defaultdict(lambda: [0, 0, 0])
    for _, url in pages:
        at = located(url)
        counts[at][0] += 1
        counts[at][1] += ruled(*at)[1] == "block"
        counts[at][2] += ruled(*at)[1] == "allow"
    for url, bad in labels:
        if bad is not None:
            counts[located(url)][1 if bad else 2] += 1
        else:
            counts[located(url)]
    template = {}

    def grow(host, node, rows):  # rows: (path, rest)
        size = lambda own, k=0: sum(counts[host, p][k] for p, _ in own)
        if size(rows) < f.least:
            template.update({(host, p): node + "/**" for p, _ in rows})
            return
        template.update({(host, p): node for p, rest in rows if not rest})
        rows = [r for r in rows if r[1]]
        by = defaultdict(list)
        for r in rows:
            by[r[1][0]].append(r)

        def shares(own):
            ends = sum(counts[host, p][0] for p, rest in own if len(rest) == 1)
            digit = sum(counts[host, p][0] for p, rest in own if len(rest) > 1 and re.search("[0-9]", rest[1]))
            return [size(own, 1), size(own, 2), ends, digit]

        merged = []
        for seg, own in by.items():
            n, m = size(own), size(rows) - size(own)
            differs = n > 1 and (m == 0 or any(
                abs(x / n - (y - x) / m) > f.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) for x, y in zip(shares(own), shares(rows))
            ))
            if differs:
                grow(host, f"{node}/{seg}", [(p, rest[1:]) for p, rest in own])
            else:
                merged += own
        if merged:
            grow(host, node + "/*", [(p, rest[1:]) for p, rest in merged])

    for host in {h for h, _ in counts}:
        grow(host, "", [(p, p[1:].split("/") if p else []) for h, p in counts if h == host])
    sums = defaultdict(lambda: [0, 0])
    for (host, path), (_, bad, good) in counts.items():
        own = sums[host, template[host, path]]
        own[0] += bad
        own[1] += good
    out = []
    for page, url in pages:
        host, path = located(url)
        rule, verdict = ruled(host, path)
        bad, good = sums[host, template[host, path]]
        rejected = (bad + f.smooth / 2) / (bad + good + f.smooth) >= f.num / f.den
        out.append((page, host, path, rule, verdict or ("block" if rejected else "allow")))
    return sorted(out, key=repr)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET", "https://x.example.net/en/1?q#f", "http://net/", "http://xnet/a", "mailto:a://b.org/fr/é\n/x?y",
    "http://a.org#/fr/", "http://a.example.com/de/1", "http://example.com/de/", "http://example.com/de", "a://b://c.net/x", "http://u@h.net:80/x", "http://q//a//b/",
]


def test_url_filters(spark):
    rng = random.Random(3)
    pages = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[5]), (None, URLS[5])]
    labels = [("http://shop.test/promo/1", None), (None, True)]
    for i in range(400):
        kind = rng.choice(["promo", "news", "user", "about", "deal"])
        url = f"http://shop.test/{kind}/{rng.randint(0, 300)}" + rng.choice(["", "/", "/edit", ".html", "/c/" + str(i)])
        pages.append((100 + i, url))
        if rng.random() < 0.4:
            labels.append((url, kind in ("promo", "deal")))
        lang = rng.choice(["en", "de", "fr"])
        pages.append((1000 + i, f"http://w{i % 5}.example.com/{lang}/{rng.randint(1, 99)}"))
        pages.append((2000 + i, f"http://w{i % 3}.example.org/{lang}/{rng.randint(1, 99)}/" + "d/" * (i % 9)))
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'h' AS host", "'t' AS template", "1 AS n", "'r' AS rest", "2 AS total")
    given = spark.createDataFrame(labels, "url string, bad boolean")
    got = urls.judged(frame, labels=given)
    want = url_verdicts(pages, urls.RULES, labels, urls.Filter())
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    verdicts = Counter((w[2].split("/")[1], w[4]) for w in want if w[1] == "shop.test")
    assert verdicts["promo", "block"] > 60 and not verdicts["promo", "allow"] and not verdicts["news", "block"]
    assert sum(w[3] is None and w[4] == "block" for w in want) > 100
    assert urls.judged(frame.limit(0)).collect() == []


def test_rules_of_equal_length(spark):
    rules = [("allow", "b.org", "/"), ("block", "org", "/a/"), ("block", "org", "/"), ("allow", "org", "/b/")]
    frame = spark.createDataFrame([(1, "http://b.org/a/"), (2, "http://b.org/b/"), (3, "http://c.org/b/"), (4, "http://c.org/c")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged(frame, rules).collect()}
    assert got == {1: ("org/a/", "block"), 2: ("b.org/", "allow"), 3: ("org/b/", "allow"), 4: ("org/", "block")}


# Spelling variants.


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_rows(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return sorted(out)


def test_spelling_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 7)
    rng = random.Random(9)
    counts = {}
    for _ in range(120):
        word = "".join(rng.choices("abcdehñÀ", k=rng.randint(1, 9)))
        n = rng.choice([1, 2, 30, 400, 5000, 100_000])
        counts[word] = n
        for _ in range(4):
            at = rng.randrange(len(word) + 1)
            other = word[:at] + rng.choice(["", "a", "ü", "z"]) + word[at + rng.randint(0, 1) :]
            if other:
                counts.setdefault(other, max(1, n // rng.choice([1, 9, 10, 11])))
            word = other or word
    long = "ab" * 60_000
    counts |= {long: 50, long + "c": 5, long[:-1] + "x": 500, "chain": 1, "chains": 10, "chainse": 100, "chainsed": 1000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "1 AS best", "'x' AS letters")
    got = spelling.grouped(words).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == spelling_rows(counts)
    assert {w[5] for w in spelling_rows(counts) if w[0].startswith("chain")} == {"chainsed"}


def test_spelling_variants_of_documents(spark):
    rows = [*EDGE_ROWS, (10, "Mispelling mispelling MISPELLING misspelling Misspelling misspélling x" * 3, None), (None, None, None)]
    rows += [(100 + i, "considerable Considérable considerably " * (i % 5), None) for i in range(60)]
    counts = Counter()
    for id_, text, _ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = spelling.variants(documents(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == spelling_rows(counts)
    assert spelling.variants(documents(spark, rows).limit(0)).collect() == []

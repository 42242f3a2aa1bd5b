"""Shared inputs of the tests: edge rows and plain Python twins."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF_DIR = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

#: Rows that any operator on documents must take: nulls, empty and very long texts, repeats, ties.
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away home", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away home", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away home", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \n\t ", None),
    (6, LONG, "en"),
    (None, "a text without an id", "en"),
    (7, "12345 !!! 678", "de"),
    (8, "one", "fr"),
    (9, "naïve café ☃ 日本語 \U0001f600 end", None),
]


def documents(spark, rows=None, extra=True):
    """Documents with extra columns whose names clash with those that operators add."""
    rows = EDGE_ROWS if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        df = df.selectExpr(
            "*", "'x' AS ids", "1 AS score", "'y' AS secrets", "'z' AS items", "2 AS class", "'d' AS decoded", "3 AS runs", "'p' AS lang_pred", "4 AS id", "'q' AS row"
        )
    return df


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_components(rows, n=4, num=85, den=100):
    """[(id, size, component)] of (id, text) rows, by counting every overlap."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, own in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = Counter(j for g in own for j in where[g])
        for j, k in shared.items():
            if den * k >= num * (len(own) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in own:
            where[g].append(i)
    smallest = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            smallest[find(i)] = min(id_, smallest.get(find(i), id_))
    return [(id_, len(s), None if id_ is None else smallest[find(i)]) for i, ((id_, _), s) in enumerate(zip(rows, sets))]


BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, size=10):
    """{id: (words, hit words, items)} by trying every window at every place."""
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for at in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[at : at + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for id_, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for at in range(len(words)):
            for n in lengths:
                own = tuple(words[at : at + n])
                if len(own) == n and own in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[own]
        out.append((id_, len(words), len(hit), tuple(sorted(found))))
    return out

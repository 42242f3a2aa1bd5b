"""Benchmark decontamination: an FM-index per shard of documents, searched for all test phrases.

A task indexes the words of a few megabytes of documents at a time, searches every benchmark window
backwards through the wavelet ranks, all windows at once, finds the places of the occurrences by sampled
suffix positions and merges them to removal spans. No document leaves its task. Phrases are given to the
tasks in blocks of at most ``max_windows``, one broadcast per block; with more than one block the passes
follow each other within the same stage, each adding its spans to those of the pass before.

A benchmark text of fewer words than a window is one window; texts without words, nulls among them, have
none. Rows of documents without words have no spans. Benchmark rows without an id count as item "".
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.common import byte_slices, give_back, numbered, small_batches
from veilscan.llm.fmindex import Index

#: ASCII characters that are no word characters become blanks; bytes of other characters stay.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: The same words in a text, for positions.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RUN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
ADDED = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("runs", T.ArrayType(RUN, False), False),  # hit words, as ranges of word numbers
    T.StructField("spans", T.ArrayType(RUN, False), False),  # the same in code points
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
]


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(WORD_BYTES).split() if text else []


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``item, phrase`` (words joined by blanks), one row per window."""

    def run(batches):
        for batch in batches:
            items, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text)
                for at in range(max(1, len(own) - size + 1) if own else 0):
                    items.append(item)
                    phrases.append(b" ".join(own[at : at + size]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.string())], names=["item", "phrase"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    return rows.mapInArrow(run, "item string, phrase string").distinct()


class Phrases:
    """One block of windows: a vocabulary, a matrix of word numbers, and the items of each phrase."""

    def __init__(self, rows: list[tuple[str, str]], size: int):
        number: dict[str, int] = {}
        vocabulary: dict[bytes, int] = {}
        lines: list[list[int]] = []
        self.items: list[list[str]] = []
        for item, phrase in rows:
            if phrase not in number:
                number[phrase] = len(lines)
                lines.append([vocabulary.setdefault(w, len(vocabulary)) for w in phrase.encode().split()])
                self.items.append([])
            self.items[number[phrase]].append(item)
        self.words = list(vocabulary)
        self.lengths = np.array([len(line) for line in lines], dtype=np.int64)
        self.matrix = np.full((len(lines), size), -1, dtype=np.int64)
        for line, own in zip(self.matrix, lines, strict=True):
            line[size - len(own) :] = own


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def occurrences(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: document, number of its first word, phrase."""
    numbers = _Numbers()
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends] = False
    symbols[inner] = np.fromiter((n for d in docs for n in map(numbers.__getitem__, d)), dtype=np.int64, count=int(lengths.sum()))
    known = np.array([numbers.get(w, 0) for w in phrases.words] + [-1], dtype=np.int64)
    lines = known[phrases.matrix]
    possible = np.flatnonzero((lines != 0).all(axis=1))  # all their words are in this shard
    if not len(possible):
        return (np.zeros(0, dtype=np.int64),) * 3
    index = Index(symbols, ends, len(numbers) + 1)
    own, low, high = index.search(lines[possible])
    n = high - low
    rows = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    at = index.locate(rows)
    doc = np.searchsorted(ends, at)
    return doc, at - (ends - lengths)[doc], np.repeat(possible[own], n)


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return list(zip(first[new].tolist(), end[last].tolist(), strict=True))


def search_batch(batch: pa.RecordBatch, at: int, phrases: Phrases) -> list[pa.Array]:
    """The added columns for one shard; what the batch has of them already is merged in."""
    texts = batch.column(at).to_pylist()
    docs = [words(t) for t in texts]
    runs = [[(r["start"], r["end"]) for r in own] for own in batch.column("runs").to_pylist()]
    items = [set(own) for own in batch.column("items").to_pylist()]
    spans = [[] for _ in texts]
    doc, first, phrase = occurrences(docs, phrases)
    for i in np.unique(doc).tolist():
        own = doc == i
        begin, which = first[own], phrase[own]
        old = np.array(runs[i], dtype=np.int64).reshape(-1, 2)
        runs[i] = merged(np.concatenate([old[:, 0], begin]), np.concatenate([old[:, 1], begin + phrases.lengths[which]]))
        for p in np.unique(which).tolist():
            items[i].update(phrases.items[p])
    for i, own in enumerate(runs):
        if own:
            place = [m.span() for m in WORDS.finditer(texts[i])]
            spans[i] = [(place[a][0], place[b - 1][1]) for a, b in own]
    pairs = lambda lists: pa.array([[dict(start=a, end=b) for a, b in own] for own in lists], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return [pa.array([len(d) for d in docs], pa.int64()), pairs(runs), pairs(spans), pa.array([sorted(own) for own in items], pa.list_(pa.string()))]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 500_000, shard_bytes: int = 2 << 20, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words, runs, spans, items`` (input columns of these names give way)."""
    names = [f.name for f in ADDED]
    spark = docs.sparkSession
    small_batches(spark)
    done = docs.drop(*names)
    at = done.columns.index(text_col)
    schema = T.StructType([*done.schema.fields, *ADDED])
    found = windows(benchmark, window)
    blocks = max(1, math.ceil(found.count() / max_windows))
    done = done.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(ADDED[1].dataType).alias("runs"),
        F.array().cast(ADDED[2].dataType).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for b in range(blocks):
        own = found.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(Phrases([tuple(r) for r in own.collect()], window))
        done = done.mapInArrow(searcher(held, at, len(schema) - len(ADDED), schema.names, shard_bytes), schema)
    return done


def searcher(held, at: int, kept: int, names: list[str], shard_bytes: int):
    def run(batches):
        phrases = held.value
        for whole in batches:
            for batch in byte_slices(whole, at, shard_bytes):
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *search_batch(batch, at, phrases)], names=names)
        give_back()

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any test phrase."""
    rows = numbered(docs)
    done = contamination(rows, benchmark, text_col=rows.columns[docs.columns.index("text")])
    return done.where(F.size("runs") == 0).select(*rows.columns).toDF(*docs.columns)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    done = contamination(docs.select("doc_id", "text"), benchmark)
    hits = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return done.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


DIGESTS_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
     w AS (SELECT kind, id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
     b AS (SELECT DISTINCT id AS item, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS p
           FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
     d AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE kind = 'd'),
     h AS (SELECT d.id, d.i, b.n, b.item FROM (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
           FROM d, (SELECT DISTINCT n FROM b) WHERE i + n - 1 <= len(w)) d JOIN b USING (n, p)),
     x AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY id),
     y AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN x ON w.id = x.id LEFT JOIN y ON w.id = y.id WHERE kind = 'd'
"""

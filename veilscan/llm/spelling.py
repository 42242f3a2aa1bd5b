"""Spelling variants: words one edit apart, found by Gram matrices of letter counts, and their usual forms.

1. *Blocks.* Words of one length with the same coarse letter counts (letters dealt into ``GROUPS`` groups by code
   point) are a block. One edit moves the length and each group's count by one at most, so a block has only to be
   compared with itself, with blocks of its length that have one letter more in one group and one less in another,
   and with blocks of the next length that have one letter more in one group.
2. *Tiles.* Sorted blocks are cut into tiles of ``TILE`` words at most, one row each, a byte per letter. So a block
   that holds a third of all words is many rows. Tiles meet by a join on the block; a task puts the tiles of a batch
   that meet the same one together to one product.
3. *Gram matrix.* With letter counts as vectors, ``|x|^2 + |y|^2 - 2 x.y`` is the squared distance of all pairs of
   two tiles at once; an insertion makes it 1, a replacement 2. Pairs above 2 are dropped.
4. *Edits.* Pairs that are left are compared letter by letter.

Of each product a task passes on, per word, how many near words it has there and the best of them; Spark adds up
and keeps the best before it shuffles. Chains of forms are followed by doubling: a form has ten times its word's
count, so a count of c has log10(c) forms above it at most, which fixes the number of rounds.

Nulls among texts have no words. Repeated rows count as often as they stand there. A null doc_id is written as
the empty string before its colon. Ties between near words go to the smaller word in code-point order. Empty tables
give no rows. Extra columns of the documents, whatever their names, are not looked at. A word may be of any length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import small_batches, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]"
GROUPS = 7
#: Words and bytes of a tile at most (one word at least).
TILE, TILE_BYTES = 1_024, 1 << 20
#: Candidates that are compared letter by letter at once, in bytes.
COMPARED = 1 << 22
#: Words that one tile is compared with in one product.
STACK = 4_096
#: Columns of the count vectors: a-z, and other letters folded into six (which can only make distances smaller).
COLUMNS = 32
COLUMN = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])

TILES = "length int, counts array<int>, first binary, letters binary, ns binary"


def misspelt_runs(docs: DataFrame, shortest: int, every: int = 31) -> DataFrame:
    """``word``, a row per occurrence: runs of letters in ``docs``, A-Z lower-cased, one of ``every`` without a letter.

    Which runs lose a letter, and which letter, is a matter of the checksum of doc_id and run.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{shortest},}})"), F.lit(1))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h")).select("run", "h", (F.col("h") % F.length("run")).cast("int").alias("at"))
    shorter = F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest)


def counted(occurrences: DataFrame, least: int) -> DataFrame:
    """``word, n`` of the words with ``least`` occurrences or more."""
    return occurrences.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def tiles(words: DataFrame) -> DataFrame:
    """Blocks of ``word, n`` in tiles."""
    groups = ["".join(map(chr, range(g or GROUPS, 256, GROUPS))) for g in range(GROUPS)]
    size = F.length("word")
    counts = F.array(*[size - F.length(F.translate("word", g, "")) for g in groups])
    rows = words.select(size.alias("length"), counts.alias("counts"), F.encode("word", "ISO-8859-1").alias("letters"), "n")
    order = ["length", "counts", "letters"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in TILES.split(", ")]
    kinds = (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(0).to_numpy()
            counts = batch.column(1).flatten().to_numpy().reshape(-1, GROUPS)
            letters, ns = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            other = (np.diff(lengths) != 0) | (np.diff(counts, axis=0) != 0).any(axis=1)
            edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(lengths)]
            made = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                step = max(1, min(TILE, TILE_BYTES // int(lengths[a])))
                for at in range(a, b, step):
                    own = slice(at, min(b, at + step))
                    made.append((int(lengths[a]), counts[a].tolist(), letters[at], b"".join(letters[own]), ns[own].tobytes()))
            for at in range(0, len(made), 16):
                columns = zip(*made[at : at + 16], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, TILES)


def met(tiles: DataFrame) -> DataFrame:
    """All pairs of tiles that can hold words one edit apart, each once."""

    def more(counts, i: int, by: int):
        return F.transform(counts, lambda x, j: F.when(j == i, x + by).otherwise(x))

    own = F.col("counts")
    longer = [F.struct((F.col("length") + 1).alias("l"), more(own, i, 1).alias("c")) for i in range(GROUPS)]
    # Of two blocks of one length, the one with the greater counts, compared from the first on, is found from the other.
    level = [
        F.when(F.element_at(own, j + 1) > 0, F.struct(F.col("length").alias("l"), more(more(own, i, 1), j, -1).alias("c")))
        for i in range(GROUPS)
        for j in range(i + 1, GROUPS)
    ]
    itself = F.struct(F.col("length").alias("l"), own.alias("c"))
    left = tiles.select(
        F.col("first").alias("a_first"), F.col("length").alias("a_length"), F.col("letters").alias("a"), F.col("ns").alias("a_n"),
        own.alias("a_counts"), F.explode(F.array_compact(F.array(itself, *level, *longer))).alias("to"),
    )
    right = tiles.select(
        itself.alias("to"), F.col("first").alias("b_first"), F.col("length").alias("b_length"), F.col("letters").alias("b"), F.col("ns").alias("b_n")
    )
    other = (F.col("a_length") != F.col("b_length")) | (F.col("a_counts") != F.col("to.c"))
    pairs = left.join(right, "to").where(other | (F.col("a_first") <= F.col("b_first")))
    return pairs.select("a_first", "a_length", "a", "a_n", "b_first", "b_length", "b", "b_n")


def vectors(letters: np.ndarray, left: bool) -> np.ndarray:
    """Letter counts, with two columns more that take half the squared lengths off a product of a left and a right one."""
    n, length = letters.shape
    at = COLUMN[letters] + np.arange(n)[:, None] * COLUMNS
    counts = np.bincount(at.ravel(), minlength=n * COLUMNS).reshape(n, COLUMNS)
    # Single precision holds counts and their products exactly while words are short.
    counts = counts.astype(np.float32 if length < 1_000 else np.float64)
    half = (counts * counts).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(half)
    return np.hstack([counts, -half, one] if left else [counts, one, -half])


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (as long, or one letter longer) that are one edit apart."""
    left, right = vectors(a, True), vectors(b, False)
    # Minus half the squared distance: -1 is a distance of two.
    i, j = np.nonzero(left @ right.T > -1.25)
    kept = np.zeros(len(i), dtype=bool)
    step = max(1, COMPARED // a.shape[1])
    for at in range(0, len(i), step):
        x, y = a[i[at : at + step]], b[j[at : at + step]]
        if a.shape[1] == b.shape[1]:
            kept[at : at + step] = (x != y).sum(axis=1) == 1
        else:
            # From the first letter that differs on, the longer word must go on as the shorter one, one letter later.
            differs = np.hstack([x != y[:, :-1], np.ones((len(x), 1), dtype=bool)])
            first = differs.argmax(axis=1)
            later = x != y[:, 1:]
            kept[at : at + step] = ~(later & (np.arange(x.shape[1]) >= first[:, None])).any(axis=1)
    return i[kept], j[kept]


def best_of(words: np.ndarray, own: np.ndarray, others: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[list, ...]:
    """For each word: how many near ones, and of these the largest count and its word."""
    spelt = np.ascontiguousarray(others[other]).view(f"S{others.shape[1]}").ravel()
    order = np.lexsort((spelt, -n[other], own))
    own, other = own[order], other[order]
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    text = lambda rows: [r.tobytes().decode("latin-1") for r in rows]
    return text(words[own[heads]]), np.diff(np.append(heads, len(own))).tolist(), n[other[heads]].tolist(), text(others[other[heads]])


def matrix(letters: bytes, length: int) -> np.ndarray:
    return np.frombuffer(letters, dtype=np.uint8).reshape(-1, length)


def stacked(rows: list[tuple]) -> Iterator[tuple]:
    """Pairs of tiles put together: one tile, and all that it meets of one length, up to ``STACK`` words at a time.

    Gives ``(left letters, counts, right letters, counts, left tile is the stack, number of a stack's word in the
    other tile where both are the same tile)``.
    """
    lefts, rights = len({r[0] for r in rows}), len({r[4] for r in rows})
    by_right = rights <= lefts
    groups = defaultdict(list)
    for a_first, la, a, a_n, b_first, lb, b, b_n in rows:
        one, many = ((b_first, lb, b, b_n), (a_first, la, a, a_n)) if by_right else ((a_first, la, a, a_n), (b_first, lb, b, b_n))
        groups[one[0], many[1]].append((one, many))
    for (first, length), own in groups.items():
        one, one_n = matrix(own[0][0][2], own[0][0][1]), np.frombuffer(own[0][0][3], dtype=np.int64)
        at = 0
        while at < len(own):
            end, size = at, 0
            while end < len(own) and (end == at or size + len(own[end][1][3]) // 8 <= STACK):
                size += len(own[end][1][3]) // 8
                end += 1
            many = [m for _, m in own[at:end]]
            numbers = [np.arange(len(m[3]) // 8) if m[0] == first and m[1] == one.shape[1] else np.full(len(m[3]) // 8, -1) for m in many]
            stack = matrix(b"".join(m[2] for m in many), length), np.frombuffer(b"".join(m[3] for m in many), dtype=np.int64)
            yield (*stack, one, one_n, True, np.concatenate(numbers)) if by_right else (one, one_n, *stack, False, np.concatenate(numbers))
            at = end


def near(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of ``word, n`` that have near ones; words must be distinct."""

    def run(batches):
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for a, a_n, b, b_n, by_right, number in stacked(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                i, j = near_pairs(a, b)
                # Within one tile a pair is taken once.
                kept = number[i] < j if by_right else number[j] < i
                i, j = i[kept], j[kept]
                if len(i):
                    for part in (best_of(a, i, b, j, b_n), best_of(b, j, a, i, a_n)):
                        for column, values in zip(found, part, strict=True):
                            column.extend(values)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=["word", "k", "m", "best"])

    rows = met(tiles(words)).mapInArrow(run, "word string, k long, m long, best string")
    best = F.min(F.struct((-F.col("m")).alias("m"), "best")).alias("best")
    return rows.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.best").alias("best"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word, root``: the last of each chain of ``word, form``, by doubling."""
    step = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = store(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return step


def grouped(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``word, n``.

    Words consist of characters up to U+00FF; a word that comes more than once has the sum of its counts.
    """
    spark = words.sparkSession
    small_batches(spark)
    words = store(words.where("word != ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    usual = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n"),
    )
    found = store(found, "found")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(2, most), ratio)))
    chained = roots(found.where(F.col("form").isNotNull()), math.ceil(math.log2(steps)) if steps > 1 else 0)
    return found.join(chained, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    words = counted(misspelt_runs(docs, 7), 2)
    return grouped(words).select("word", "n", "n_near", "form", "form_n", "root")


#: Near words share what is left when a letter is taken away; the checksum is computed byte by byte.
VARIANTS_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
             translate(unnest(regexp_extract_all(text, '{RUN}{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
k AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS bytes FROM r GROUP BY id, run),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
             list_transform(range(1, length(bytes), 2), lambda i: 16 * (strpos('0123456789ABCDEF', bytes[i]) - 1)
                            + strpos('0123456789ABCDEF', bytes[i + 1]) - 1)),
             lambda a, x: xor(a >> 8, t.crc[(xor(a, x) & 255) + 1]))) AS h FROM k, t),
o AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN w b ON a.rest = b.word),
s AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS best_n FROM p GROUP BY word, n),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
             CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN s USING (word)),
u AS (SELECT word, word AS root FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL),
e AS (SELECT u.word, u.root FROM u JOIN f ON f.word = u.root WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN e USING (word)
"""

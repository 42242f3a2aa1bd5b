"""Ranked lexical search with integer scores: a term-partitioned index, passed through by bundles of items.

1. *Terms.* One pass over the documents counts the terms of each whole text. Only terms that items may hold are
   kept: a bitmap of ``FILTER_BITS`` bits, the same size for any number of items, lets all of them pass, and a join
   takes out the rest.
2. *Owners.* Terms are dealt out by weight: the first owner has the rarest, the last the commonest. An owner's
   postings are cut by document into slices of about ``SLICE_POSTINGS``, so no term and no owner lands in one task.
3. *Bundles.* Items are put together to bundles of about ``BUNDLE_TERMS`` terms. Each bundle has a row per slice, which
   carries its terms and, sparsely, the sums of its documents so far. It passes all owners in turn: a stage cogroups the
   bundles with an owner's postings, adds their contributions, and hands the bundle on.
4. *Bounds.* A term adds at most a million times its weight. In each slice, a document is dropped when its sum and all
   that may still come stay below the sum of the item's k-th best one; new documents are not begun when that holds
   for all of them. Nothing that could be among the k best, ties included, is ever dropped.
5. *Selection.* The k best of each slice meet, the window keeping k per task before it shuffles.

Documents and items without a text or without terms take no part, nor does an empty table. Each row of the documents
is a document of its own, also where ids or texts repeat; ties go to the smaller doc_id, rows without an id last. Items
that are repeated exactly are one item; texts that share an item_id are ranked each for itself. Extra columns, whatever
their names, are not looked at. Texts of any length are counted in pieces of about a megabyte.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import give_back, list_column, shared_folder, small_batches, store

#: ASCII letters and digits and all bytes of other characters make up terms; A-Z are lower-cased.
TERM = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
SLICE = 1 << 20
FILTER_BITS = 23
SLICE_POSTINGS, BUNDLE_TERMS = 200_000, 16_384
#: Least weights of all owners but the last.
OWNERS = (4_000, 2_000, 1_000)
#: What a term adds at most, over its weight.
FULL = 1_000_000

COUNTED = "doc_id long, n long, terms array<string>, tfs array<int>"
BUNDLES = "bundle int, slice int, terms binary, sums binary"
#: Rows of the two matrices of a bundle: item, owner, term, occurrences, these times the weight;
#: and item, document, its id, whether it has none, sum.
ITEM, OWNER, NUMBER, TIMES, MOST = range(5)
KEY, DOC, NULL, SUM = range(1, 5)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """All terms of the texts, and the number of each one's text."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = TERM[buffer]
    change = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = FOLDED[buffer[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(text_ends, starts, side="right"), words.dictionary_encode()


def hashes(terms: pa.Array) -> np.ndarray:
    own = terms.to_pylist()
    return np.fromiter(map(zlib.crc32, own), dtype=np.int64, count=len(own)) & ((1 << FILTER_BITS) - 1)


def slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, with their numbers, in slices of about ``SLICE`` bytes; a longer text is a slice of its own."""
    numbers, own, size = [], [], 0
    for number, text in enumerate(texts):
        data = text.encode() if text else b""
        if own and size + len(data) > SLICE:
            yield numbers, own
            numbers, own, size = [], [], 0
        numbers.append(number)
        own.append(data)
        size += len(data)
    if own:
        yield numbers, own


def parts(text: bytes) -> Iterator[bytes]:
    """A long text, cut between terms."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def counts_of(texts: list[bytes], bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of each text: how many terms, how many of them are kept; and of all together: the kept terms, their occurrences."""
    rows, words = terms_of(texts)
    n = np.bincount(rows, minlength=len(texts))
    code, dictionary = words.indices.to_numpy(), words.dictionary
    if bitmap is not None:
        kept = bitmap[hashes(dictionary)][code]
        rows, code = rows[kept], code[kept]
    pairs, times = np.unique(rows * np.int64(max(1, len(dictionary))) + code, return_counts=True)
    rows, code = np.divmod(pairs, max(1, len(dictionary)))
    return n, np.bincount(rows, minlength=len(texts)), dictionary.take(pa.array(code)), times


def counts_of_long(text: bytes, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    n, total = 0, Counter()
    for part in parts(text):
        own, _, terms, times = counts_of([part], bitmap)
        n += int(own[0])
        total.update(dict(zip(terms.to_pylist(), times.tolist(), strict=True)))
    return np.array([n]), np.array([len(total)]), pa.array(list(total), pa.binary()), np.fromiter(total.values(), dtype=np.int64, count=len(total))


def counted(docs: DataFrame, bitmap: np.ndarray | None) -> DataFrame:
    """``doc_id, n, terms, tfs``: the terms of each text whose bits are set, with their occurrences; ``n`` counts all."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for numbers, texts in slices(batch.column(1).to_pylist()):
                count = counts_of_long if len(texts) == 1 and len(texts[0]) > SLICE else counts_of
                n, sizes, terms, times = count(texts[0] if count is counts_of_long else texts, held.value)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                columns = [
                    batch.column(0).take(pa.array(numbers)), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, terms.cast(pa.string())), list_column(times, sizes, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))
        give_back()

    return docs.mapInArrow(run, COUNTED)


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """The bits of all terms; 64 of them are a row, so that never more than 2^17 rows come to the driver."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column(0)))], names=["bit"])

    bits = terms.select(F.col("term").cast("binary")).mapInArrow(run, "bit long")
    rows = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 64, dtype=np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def asked_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times``: the terms of each item; ``item`` numbers the items."""
    own = store(items.select("item_id", "text").where("text IS NOT NULL").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    lists = counted(own.select(F.col("item").alias("doc_id"), "text"), None)
    rows = lists.select(F.col("doc_id").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    return rows.join(own.select("item", "item_id"), "item").select("item", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))


def bundles_of(asked: DataFrame, slices: int) -> DataFrame:
    """A row per bundle and slice, without sums. ``asked``: ``bundle`` and the rows of a bundle's first matrix."""
    names = ["item", "owner", "number", "times", "most"]

    def run(batches):
        for batch in batches:
            data = []
            for own in batch.column(1).to_pylist():
                terms = np.array([[x[c] for c in names] for x in own], dtype=np.int64)
                data.append(terms[np.lexsort((terms[:, NUMBER], terms[:, ITEM]))].T.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["bundle", "terms"])

    lists = asked.groupBy("bundle").agg(F.collect_list(F.struct(*names)).alias("terms"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    return lists.mapInArrow(run, "bundle int, terms binary").select("bundle", every, "terms", F.lit(b"").alias("sums"))


def least_of(sums: np.ndarray, k: int) -> int:
    """The k-th largest sum, 0 if there are fewer."""
    return int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0


def passed(terms: np.ndarray, sums: np.ndarray, owner: int, postings: dict[str, np.ndarray], k: int) -> np.ndarray:
    """The sums of a bundle after one owner's postings of a slice."""
    keys, where = np.unique(np.concatenate([sums[KEY], postings["key"]]), return_inverse=True)
    held, posted = where[: sums.shape[1]], where[sums.shape[1] :]
    doc, null = np.zeros((2, len(keys)), dtype=np.int64)
    doc[held], null[held] = sums[DOC], sums[NULL]
    doc[posted], null[posted] = postings["doc_id"], postings["null"]
    order = np.argsort(postings["number"], kind="stable")
    number, posted, adds = postings["number"][order], posted[order], postings["adds"][order]
    items = np.unique(np.concatenate([terms[ITEM], sums[ITEM]]))  # an item whose terms have all been passed has sums only
    starts, ends = (np.searchsorted(terms[ITEM], items, side=s).tolist() for s in ("left", "right"))
    order = np.argsort(sums[ITEM], kind="stable")
    held, so_far = held[order], sums[SUM][order]
    first, last = (np.searchsorted(sums[ITEM][order], items, side=s).tolist() for s in ("left", "right"))
    total = np.zeros(len(keys), dtype=np.int64)
    out = [sums[:, :0]]
    for i, item in enumerate(items.tolist()):
        own = terms[:, starts[i] : ends[i]]
        docs, before = held[first[i] : last[i]], so_far[first[i] : last[i]]
        now = own[:, own[OWNER] == owner]
        later = FULL * int(own[MOST, own[OWNER] > owner].sum())
        total[docs] = before
        low, high = (np.searchsorted(number, now[NUMBER], side=s).tolist() for s in ("left", "right"))
        for a, b, times in zip(low, high, now[TIMES].tolist(), strict=True):
            total[posted[a:b]] += times * adds[a:b]
        closed = least_of(before, k) > later + FULL * int(now[MOST].sum())
        found = docs if closed else np.flatnonzero(total)
        scores = total[found]
        kept = scores + later >= least_of(scores, k)
        found, scores = found[kept], scores[kept]
        out.append(np.stack([np.full(len(found), item), keys[found], doc[found], null[found], scores]))
        total[:] = 0
    return np.concatenate(out, axis=1)


def stage(bundles: DataFrame, postings: DataFrame, owner: int, k: int) -> DataFrame:
    """All bundles, each with its slice of one owner's postings."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        terms, sums = (np.frombuffer(row[c], dtype=np.int64).reshape(5, -1) for c in ("terms", "sums"))
        own = {c: right[c].to_numpy() for c in ("key", "number", "adds")}
        own["doc_id"], own["null"] = right["doc_id"].fill_null(0).to_numpy(), right["doc_id"].is_null().to_numpy().astype(np.int64)
        row["sums"] = passed(terms, sums, owner, own, k).tobytes()
        row["terms"] = np.ascontiguousarray(terms[:, terms[OWNER] > owner]).tobytes() if owner < len(OWNERS) else b""
        return pa.table({c: pa.array([v], kind) for (c, v), kind in zip(row.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

    return bundles.groupBy("bundle", "slice").cogroup(postings.groupBy("bundle", "slice")).applyInArrow(run, BUNDLES)


def unpacked(bundles: DataFrame) -> DataFrame:
    names = ["item", "doc_id", "score"]

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                sums = np.frombuffer(data, dtype=np.int64).reshape(5, -1)
                doc = pa.array(sums[DOC], mask=sums[NULL] == 1)
                yield pa.RecordBatch.from_arrays([pa.array(sums[ITEM]), doc, pa.array(sums[SUM])], names=names)

    return bundles.select("sums").mapInArrow(run, "item long, doc_id long, score long")


def top_k(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0 for each item.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; doc_ids are whole numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = store(asked_terms(items), "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    forward = store(counted(texts, bitmap_of(asked)).withColumn("key", F.monotonically_increasing_id()), "forward")
    size = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * size.n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    total = asked.agg(F.count("*")).first()[0]
    bundle = F.pmod(F.xxhash64("item"), F.lit(max(1, math.ceil(total / BUNDLE_TERMS)))).cast("int")
    used = asked.groupBy("term").agg(F.collect_set(bundle).alias("bundles")).join(frequency, "term").withColumn("weight", weight)
    owner = sum((F.when(F.col("weight") < least, 1).otherwise(0) for least in OWNERS), F.lit(0)).alias("owner")
    # Terms of weight 0, which almost all documents hold, add nothing.
    used = store(used.where("weight > 0").select("term", "bundles", "df", "weight", owner, F.monotonically_increasing_id().alias("number")), "used")
    postings = used.agg(F.coalesce(F.sum(F.col("df") * F.size("bundles")), F.lit(0))).first()[0]
    slices = max(1, math.ceil(postings / SLICE_POSTINGS))
    # In the shortest document, of one term, m is 75 or a little more.
    m = F.expr(f"75L + (25L * n * {size.n}L) div {max(1, size.terms)}L")
    adds = F.expr("weight * ((1000000000L * tf) div (1000L * tf + 12L * m))")
    rows = forward.select("key", "doc_id", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    rows = rows.select("key", "doc_id", "m", F.col("t.terms").alias("term"), F.col("t.tfs").cast("long").alias("tf")).join(used, "term")
    cut = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice")
    rows = rows.select("owner", F.explode("bundles").alias("bundle"), cut, "key", "doc_id", "number", adds.alias("adds"))
    path = f"{shared_folder(spark)}/postings"
    rows.write.partitionBy("owner").parquet(path)
    index = spark.read.schema(rows.schema).parquet(path) if slices and postings else rows.limit(0)
    terms = asked.join(used, "term").select(
        bundle.alias("bundle"), "item", "owner", "number", F.col("times").cast("long").alias("times"), (F.col("times") * F.col("weight")).alias("most")
    )
    bundles = bundles_of(terms, slices)
    for number in range(len(OWNERS) + 1):
        bundles = stage(bundles, index.where(F.col("owner") == number).drop("owner"), number, k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = unpacked(bundles).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


RANKED_SQL = """
WITH t AS (SELECT id, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
           FROM (SELECT row_number() OVER () AS id, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                 FROM (SELECT DISTINCT item_id, text FROM benchmark))),
     q AS (SELECT id, item_id, w, count(*) AS times FROM t GROUP BY ALL),
     o AS (SELECT id, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
           FROM (SELECT row_number() OVER () AS id, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
                 FROM documents)),
     c AS (SELECT id, doc_id, w, count(*) AS tf FROM o GROUP BY ALL),
     d AS (SELECT id, count(*) AS n FROM o GROUP BY id),
     s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
     f AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
           FROM (SELECT w, count(*) AS df FROM c GROUP BY w), s),
     p AS (SELECT q.id AS item, q.item_id, c.id, c.doc_id,
                  sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
           FROM q JOIN c USING (w) JOIN f USING (w) JOIN d ON d.id = c.id, s GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""

"""Exact top-k search by inner product, with vectors in buckets of similar length.

Vectors are dealt out by length, longest first (ties by id, so that any number of equal vectors splits),
and stored as buckets of at most ``BUCKET`` vectors. Queries go to the tasks in blocks of bounded size, one
broadcast each. The longest bucket of every dimension is searched first; its k-th best score is a lower
bound for each query. In every other bucket a query's bound, divided by both lengths, is the least cosine
that a result can have there. Above 1 the bucket has none. Where it is high, coordinates prune: a vector
must lie within a small interval on each of the query's largest coordinates, read off lists sorted by
coordinate. Otherwise lengths prune: only vectors long enough for the bound come into question. What is
left is multiplied out, and a task's own results raise its bounds as it goes on.

Components become floor(64 * x). Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id. Vectors of different dimensions have no product and don't meet. A row that is repeated
exactly counts once; rows with the query's id are never its results. Products must stay below 2^53.
Columns other than ``vec_id`` and ``embedding`` are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import small_batches, store

BUCKET = 4_096
QUERY_BYTES = 16 << 20
#: Local cosine from which coordinates prune, and how many of a query's coordinates are looked at.
COORDINATE_COSINE, FOCUS = 0.6, 4
STEP = 256

BUCKETS = "number int, dim int, longest double, ids binary, data binary"


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(scale * x).cast("double")).alias("v")).distinct()


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def bucketed(vectors: DataFrame) -> DataFrame:
    """Buckets of vectors by dimension and falling length; ``number`` 0 is the longest of a task's range."""
    rows = vectors.select(
        F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("square"), "vec_id", "v"
    )
    order = [F.col("dim"), F.col("square").desc(), F.col("vec_id")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in BUCKETS.split(", ")]

    def run(batches):
        number = 0
        for batch in batches:
            dims = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for at in range(a, b, BUCKET):
                    part = batch.slice(at, min(BUCKET, b - at))
                    dim = int(dims[at])
                    columns = [[number], [dim], [math.sqrt(part.column(1)[0].as_py())], [part.column(2).to_numpy().tobytes()], [matrix(part.column(3), dim).tobytes()]]
                    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
                    number += 1

    return rows.mapInArrow(run, BUCKETS)


class Queries:
    """One block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.length = np.sqrt((v * v).sum(axis=1))
        self.unit = v / np.maximum(self.length, 1e-300)[:, None]
        self.bound = np.full(len(ids), -np.inf)
        # The coordinates that say most about a query.
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k = queries, k
        self.score = np.full((len(queries.ids), k), -np.inf)
        self.id = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        self.bound = queries.bound.copy()

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = (scores >= self.bound[row]) & (ids != self.q.ids[row])
        if not kept.any():
            return
        scores = np.concatenate([self.score[row], scores[kept]])
        ids = np.concatenate([self.id[row], ids[kept]])
        if len(scores) > 4 * self.k:  # only what ties with the k-th score or beats it is sorted
            least = -np.partition(-scores, self.k - 1)[self.k - 1]
            scores, ids = scores[scores >= least], ids[scores >= least]
        order = np.lexsort((ids, -scores))[: self.k]
        self.score[row], self.id[row] = scores[order], ids[order]
        self.bound[row] = max(self.bound[row], self.score[row, -1])

    def rows(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.q.ids[row]), pa.array(self.id[row, place]), pa.array(self.score[row, place].astype(np.int64))],
            names=["query_id", "vec_id", "score"],
        )


def search_bucket(best: Best, ids: np.ndarray, v: np.ndarray) -> None:
    q = best.q
    length = np.sqrt((v * v).sum(axis=1))  # falling
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = best.bound / (q.length * length[0])
    # A query or a bucket of zeros has products of 0 only.
    cosine = np.where(np.isfinite(cosine), cosine, np.where(best.bound > 0, 2.0, -1.0))
    narrow = np.flatnonzero((cosine >= COORDINATE_COSINE) & (cosine <= 1 + 1e-9))
    if len(narrow):
        unit = v / np.maximum(length, 1e-300)[:, None]
        orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in narrow:
            # Shorter vectors need a higher cosine, so the longest one's is a bound for all.
            c = min(1.0, max(-1.0, cosine[row]))
            best_list, lists = None, []
            for f in q.focus[row]:
                if f not in orders:
                    order = np.argsort(unit[:, f], kind="stable")
                    orders[f] = order, unit[order, f]
                x = q.unit[row, f]
                spread = math.sqrt(max(0.0, (1 - x * x) * (1 - c * c))) + 1e-9
                order, values = orders[f]
                a, b = np.searchsorted(values, [x * c - spread if x * c - spread > -1 else -2, 2 if x >= c else x * c + spread])
                if x <= -c:
                    a = 0
                lists.append((b - a, f, a, b))
            n, f, a, b = min(lists)
            best_list = orders[f][0][a:b]
            for _, g, a, b in sorted(lists)[1:]:
                values = orders[g][1]
                if a < b and len(best_list):
                    near = unit[best_list, g]
                    best_list = best_list[(near >= values[a]) & (near <= values[b - 1])]
                else:
                    best_list = best_list[:0]
            if len(best_list):
                best.add(row, v[best_list] @ q.v[row], ids[best_list])
    wide = np.flatnonzero(cosine < COORDINATE_COSINE)
    if len(wide):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(best.bound[wide] > 0, best.bound[wide] / q.length[wide] * (1 - 1e-9), 0.0)
        reach = np.searchsorted(-length, -least, side="right")  # vectors that are long enough
        order = np.argsort(reach, kind="stable")
        for at in range(0, len(order), STEP):
            own = order[at : at + STEP]
            n = int(reach[own].max())
            if n:
                scores = q.v[wide[own]] @ v[:n].T
                for row, line, r in zip(wide[own], scores, reach[own], strict=True):
                    best.add(row, line[:r], ids[:r])


def searched(buckets: DataFrame, queries: Queries, k: int) -> DataFrame:
    """The best of each task for each query."""
    held = buckets.sparkSession.sparkContext.broadcast(queries)
    dim = queries.v.shape[1]

    def run(batches):
        best = Best(held.value, k)
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                search_bucket(best, np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=np.float64).reshape(-1, dim))
        yield best.rows()

    return buckets.where(F.col("dim") == dim).select("ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest products of each query, ties to the smaller id.

    ``vectors`` has ``vec_id, v``; ``queries`` is a condition on its rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    asked = vectors.where(queries)
    # A few numbers per dimension.
    sizes = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    buckets = store(bucketed(vectors), "buckets")
    longest = {r["dim"]: r["longest"] for r in buckets.groupBy("dim").agg(F.max("longest").alias("longest")).collect()}
    results = []
    for dim, n in sorted((r["dim"], r["n"]) for r in sizes):
        blocks = math.ceil(n * dim * 8 / QUERY_BYTES)
        for block in range(blocks):
            own = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).toArrow().combine_chunks()
            if not own.num_rows:
                continue
            q = Queries(own["vec_id"].to_numpy(), own["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
            first = (F.col("longest") == longest[dim]) & (F.col("number") == 0)
            lead = store(searched(buckets.where(first), q, k), "lead")
            bounds = lead.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toArrow()
            place = np.argsort(q.ids)
            at = place[np.searchsorted(q.ids[place], bounds["query_id"].to_numpy())]
            # Only with one task in the lead has a query k results here, the least of which is a bound.
            q.bound[at] = bounds["least"].to_numpy() if buckets.where(first).count() == 1 else -np.inf
            results.append(searched(buckets.where(~first), q, k).unionByName(lead))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def every_twentieth(embeddings: DataFrame) -> DataFrame:
    vectors = integer_vectors(embeddings)
    return top_k(vectors, F.col("vec_id") % 20 == 0)


EVERY_TWENTIETH_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows, n-grams columns. Only pairs that can reach the threshold are ever counted:

1. *Frequent columns.* Every document's n-grams are counted over the whole corpus, in buckets of their
   hash, sent as sorted, delta-coded blocks (about two bytes each). Columns in more than ``FREQUENT``
   documents come last in the order of columns; the rest are ordered by hash.
2. *First block.* A pair that reaches the threshold shares a column among the first
   ``size - ceil(threshold * size) + 1`` ones of both rows. These columns are multiplied first: they alone
   make pairs. Rows of equal sets are one class and take part once.
3. *Pivots.* A column that many rows share does not make all their pairs. Its row with the fewest rare
   columns is its pivot; all others are paired with it. Dropped at once are pairs whose sizes are too far
   apart, or whose places say that too many columns are left out if this is the first that both have (if
   it is not, the pair belongs to an earlier column). What is left is counted over the first block.
4. *Further blocks.* The overlap of each pair is accumulated over blocks of columns; a pair whose count
   plus the columns left in the shorter row falls below the bound of its sizes is dropped at once.
5. *Next round.* Linked rows form components. Columns whose rows are all in one component are done; others
   lose their pivot and get another. Columns of at most ``SMALL`` rows, and after ``ROUNDS`` rounds all
   that are left, make the pairs of rows that are still in different components. So components are those
   of all links, though links within a component are not all looked at.

Hashes have 64 bits; two n-grams or sets that share one are not told apart (about n^2 / 2^65 for n of them).
Rows without words, nulls among them, have an empty set and link with nothing. Every input row gets a row
by its own text, also where ids repeat. A row without an id takes no part and gets no component.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import byte_slices, give_back, list_column, numbered, small_batches, store

FREQUENT = 64
SMALL = 64
ROUNDS = 3
#: At most so many frequent buckets are kept (the most frequent ones) and sent to all tasks.
MOST_BUCKETS = 1 << 21
BUCKET_BITS = 34
#: n-grams that a task sorts and sends at once.
FLUSH = 1 << 20
#: Bits of the filter that tells which sets are asked for.
FILTER_BITS = 25
BLOCKS = 4

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: Bytes that separate words, and a random number for every other byte, A-Z as a-z.
SEPARATORS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NUMBERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
NUMBERS[65:91] = NUMBERS[97:123]
#: Texts of so many bytes are hashed at once.
SLICE = 1 << 18


class Shingler:
    """Sets of n-gram hashes, sorted, of whole texts."""

    def __init__(self, n: int):
        self.n = n
        self.powers = self.inverses = np.ones(0, dtype=np.uint64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every word of all texts in turn, and how many words each text has.

        A word's hash is the sum of its bytes' numbers times powers of the multiplier, taken from
        running sums over all bytes at once.
        """
        data = [t.encode() if t else b"" for t in texts]
        buffer = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
        if len(buffer) > len(self.powers):
            size = max(len(buffer), 2 * SLICE)
            self.powers, self.inverses = (np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (MULTIPLIER, INVERSE))
        change = np.diff(SEPARATORS[buffer].astype(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
        running = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(NUMBERS[buffer] * self.powers[: len(buffer)], out=running[1:])
        hashes = mixed((running[ends] - running[starts]) * self.inverses[starts])
        text_ends = np.cumsum([len(d) + 1 for d in data])
        return hashes, np.bincount(np.searchsorted(text_ends, starts, side="right"), minlength=len(texts))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        w, lengths = self.words(texts)
        h = np.zeros(max(0, len(w) - self.n + 1), dtype=np.uint64)
        for j in range(self.n):
            h = h * MULTIPLIER + w[j : j + len(h)]
        h = mixed(h)
        out, at = [], 0
        for n in lengths.tolist():
            if n >= self.n:
                own = np.sort(h[at : at + n - self.n + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            elif n:  # the whole sequence as one
                own = np.full(1, n, dtype=np.uint64)
                for j in range(at, at + n):
                    own = own * MULTIPLIER + w[j : j + 1]
                own = mixed(own)
            else:
                own = h[:0]
            out.append(own)
            at += n
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of a hash spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def class_of(own: np.ndarray) -> int | None:
    """The number of the class of equal sets."""
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


def buckets(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BUCKET_BITS)


# Sorted numbers as the first of them and 16-bit steps; a step of 65535 goes on in the next one.


def coded(values: np.ndarray) -> bytes:
    steps = np.diff(values).astype(np.int64)
    over, rest = steps // 65535, steps % 65535
    out = np.full(len(steps) + int(over.sum()), 65535, dtype="<u2")
    out[np.cumsum(over + 1) - 1] = rest
    return values[:1].astype("<u8").tobytes() + out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, dtype="<u8", count=1).astype(np.int64)
    steps = np.frombuffer(data, dtype="<u2", offset=8).astype(np.int64)
    return np.concatenate([first, first + np.cumsum(steps)[steps != 65535]])


def frequent_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted buckets of n-grams that occur in more than ``FREQUENT`` documents, ``MOST_BUCKETS`` at most."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches):
        shingler, held, size = Shingler(n), [], 0

        def flush():
            values = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
            place = (values * np.uint64(ranges)) >> np.uint64(BUCKET_BITS)
            edges = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
            rows = [(r, coded(values[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

        for whole in batches:
            for batch in byte_slices(whole, 0, SLICE):
                for own in shingler.sets(batch.column(0).to_pylist()):
                    held.append(buckets(own))
                    size += len(own)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        yield flush()
        give_back()

    def often(table: pa.Table) -> pa.Table:
        values, counts = np.unique(np.concatenate([decoded(d) for d in table["data"].to_pylist()]), return_counts=True)
        kept = counts > FREQUENT
        return pa.table({"bucket": pa.array(values[kept], pa.int64()), "n": pa.array(counts[kept].astype(np.int64))})

    blocks = docs.select("text").mapInArrow(count, "range int, data binary")
    found = store(blocks.groupBy("range").applyInArrow(often, "bucket long, n long"), "frequent")
    if found.count() > MOST_BUCKETS:
        share = 1 - MOST_BUCKETS / found.count()
        least = found.agg(F.percentile_approx("n", share, 100_000)).first()[0]
        found = found.where(F.col("n") > least)
    return np.sort(np.array(found.select("bucket").toArrow()["bucket"].to_numpy(), dtype=np.uint64))


def heads(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """``id, size, class, rare, head``: the first columns of each row, null if this task gave them already."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["id", "size", "class", "rare", "head"]

    def run(batches):
        shingler, often, seen = Shingler(n), held.value, set()
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE):
                ids = batch.column(0).to_pylist()
                sets = shingler.sets(batch.column(1).to_pylist())
                classes = [class_of(own) for own in sets]
                rare, first = [], []
                if len(seen) > 1_000_000:
                    seen.clear()
                for i, c, own in zip(ids, classes, sets, strict=True):
                    common = in_sorted(buckets(own), often)
                    rare.append(int(len(own) - common.sum()))
                    if i is None or c is None or c in seen:
                        first.append(None)
                        continue
                    seen.add(c)
                    size = len(own)
                    first.append(np.concatenate([own[~common], own[common]])[: size + (-num * size // den) + 1].view(np.int64))
                none = np.array([x is None for x in first])
                flat = np.concatenate([x for x in first if x is not None] or [np.zeros(0, dtype=np.int64)])
                lists = list_column(flat, np.array([0 if x is None else len(x) for x in first]), pa.int64())
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(none))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array(rare, pa.int64()), lists],
                    names=names,
                )
        give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, size long, class long, rare long, head array<long>")


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def pivots(columns: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of each column but its pivot: ``col, rare, class, size, place, pivot``.

    ``pivot`` is the pivot's class, null where the two cannot reach the threshold by way of this column.
    Columns come sorted, so a task holds one batch and the pivot of the column it is at.
    """

    def run(batches):
        last = None  # (col, class of the last row, pivot's class, size and place)
        for batch in batches:
            col, rare, cls, size, place = (batch.column(i).to_numpy() for i in range(5))
            if not len(col):
                continue
            new = np.ones(len(col), dtype=bool)
            new[1:] = col[1:] != col[:-1]
            same = np.zeros(len(col), dtype=bool)  # a class again, from another task
            same[1:] = ~new[1:] & (cls[1:] == cls[:-1])
            if goes_on := last is not None and last[0] == col[0]:
                new[0], same[0] = False, cls[0] == last[1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(col)), -1))
            pivot = [x[np.maximum(at, 0)] for x in (cls, size, place)]
            if goes_on:
                for x, value in zip(pivot, last[2:], strict=True):
                    x[at < 0] = value
            last = (col[-1], cls[-1], *(x[-1] for x in pivot))
            ok = (num * np.maximum(size, pivot[1]) <= den * np.minimum(size, pivot[1])) & (
                np.minimum(size - place, pivot[1] - pivot[2]) * (num + den) >= num * (size + pivot[1])
            )
            kept = ~new & ~same
            rows = [pa.array(x[kept]) for x in (col, rare, cls, size, place)]
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array(pivot[0][kept], mask=~ok[kept])], names=["col", "rare", "class", "size", "place", "pivot"]
            )

    ordered = columns.repartition("col").sortWithinPartitions("col", "rare", "class").select("col", "rare", "class", "size", "place")
    return ordered.mapInArrow(run, "col long, rare long, class long, size long, place int, pivot long")


def promising(pairs: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that may reach the threshold by what they share in the first block.

    Up to the place where the shorter of both heads ends, all shared columns are known; beyond it
    at most the rest of the shorter row is shared.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                (xs, nx), (ys, ny) = lists_of(batch.column(2)), lists_of(batch.column(5))
                sx, rx, sy, ry = (batch.column(i).to_numpy() for i in (3, 4, 6, 7))
                row = [np.repeat(np.arange(len(n)), n) for n in (nx, ny)]
                # Keys in the order of columns: rare ones first, then by hash.
                key = []
                for v, n, r in ((xs, nx, rx), (ys, ny, ry)):
                    place = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
                    key.append((v >> np.uint64(1)) | ((place >= np.repeat(r, n)).astype(np.uint64) << np.uint64(63)))
                end = np.minimum(key[0][np.cumsum(nx) - 1], key[1][np.cumsum(ny) - 1])
                shared = shared_in(np.concatenate(row), np.concatenate(key), len(nx))
                left = [s - np.bincount(i[k <= end[i]], minlength=len(nx)) for s, i, k in zip((sx, sy), row, key, strict=True)]
                ok = (shared + np.minimum(*left)) * (num + den) >= num * (sx + sy)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(2)], names=["a", "b"])

    left, right = (first.select(F.col("class").alias(c), F.struct("head", "size", "rare").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x.*", F.col("y.head").alias("h"), F.col("y.size").alias("s"), F.col("y.rare").alias("r"))
    return both.mapInArrow(run, "a long, b long")


def shared_in(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many keys each row has twice."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    return np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1])], minlength=n)


def class_filter(classes: DataFrame) -> np.ndarray:
    """A bit for the first ``FILTER_BITS`` bits of each class: 4 MB, whatever the number of classes."""
    place = F.shiftrightunsigned("class", 64 - FILTER_BITS)
    blocks = classes.select(F.shiftright(place, 15).cast("int").alias("block"), place.bitwiseAND(32767).cast("int").alias("bit"))

    def bits(batches):
        for batch in batches:
            data = []
            for own in batch.column(1).to_pylist():
                line = np.zeros(32768, dtype=np.uint8)
                line[own] = 1
                data.append(np.packbits(line).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["block", "bits"])

    rows = blocks.groupBy("block").agg(F.collect_set("bit").alias("own")).mapInArrow(bits, "block int, bits binary").toArrow()
    out = np.zeros((1 << (FILTER_BITS - 15), 4096), dtype=np.uint8)
    for block, data in zip(rows["block"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[block] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(-1)


def sets_of(docs: DataFrame, n: int, classes: DataFrame) -> DataFrame:
    """``class, grams`` of the classes asked for (and of a few more)."""
    held = docs.sparkSession.sparkContext.broadcast(class_filter(classes))

    def run(batches):
        shingler, bits, seen = Shingler(n), held.value, set()
        for whole in batches:
            for batch in byte_slices(whole, 0, SLICE):
                if len(seen) > 1_000_000:
                    seen.clear()
                kept: dict[int, np.ndarray] = {}
                for own in shingler.sets(batch.column(0).to_pylist()):
                    c = class_of(own)
                    if c is None or c in seen:
                        continue
                    seen.add(c)
                    place = (c & (1 << 64) - 1) >> (64 - FILTER_BITS)
                    if bits[place >> 3] >> (7 - (place & 7)) & 1:
                        kept[c] = own.view(np.int64)
                flat = np.concatenate(list(kept.values()) or [np.zeros(0, dtype=np.int64)])
                lists = list_column(flat, np.array([len(x) for x in kept.values()], dtype=np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), lists], names=["class", "grams"])
        give_back()

    rows = docs.where("id is not null").select("text").mapInArrow(run, "class long, grams array<long>")
    return rows.groupBy("class").agg(F.first("grams").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose overlap reaches the threshold."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                linked = overlaps(lists_of(batch.column(2)), lists_of(batch.column(3)), num, den)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(linked)) for i in range(2)], names=["a", "b"])

    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths."""
    return column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())


def overlaps(x: tuple, y: tuple, num: int, den: int) -> np.ndarray:
    """Whether each pair of sets reaches the threshold: overlaps are accumulated block by block."""
    (xs, nx), (ys, ny) = x, y
    need = -(-num * (nx + ny) // (num + den))
    count, alive = np.zeros(len(nx), dtype=np.int64), np.minimum(nx, ny) >= need
    rest_x, rest_y = nx.copy(), ny.copy()
    row_x, row_y = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    block_x, block_y = (v >> np.uint64(64 - BLOCKS.bit_length() + 1) for v in (xs, ys))
    for block in range(BLOCKS):
        in_x, in_y = (block_x == block) & alive[row_x], (block_y == block) & alive[row_y]
        count += shared_in(np.concatenate([row_x[in_x], row_y[in_y]]), np.concatenate([xs[in_x], ys[in_y]]), len(nx))
        rest_x -= np.bincount(row_x[in_x], minlength=len(nx))
        rest_y -= np.bincount(row_y[in_y], minlength=len(nx))
        alive &= count + np.minimum(rest_x, rest_y) >= need
    return alive


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every node of links ``a, b``: the smallest node that it reaches.

    Every node takes the smallest label around it, then the label of its label, until nothing changes.
    """
    edges = store(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = store(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = store(new, "labels")
        changed = not new.where("old <> comp").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def reachable(size, place, size2, place2, num: int, den: int):
    """Whether two rows can reach the threshold if they first meet at these places."""
    size, place, size2, place2 = (F.col(c) for c in (size, place, size2, place2))
    near = num * F.greatest(size, size2) <= den * F.least(size, size2)
    return near & (F.least(size - place, size2 - place2) * (num + den) >= num * (size + size2))


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, component_id``, one row per input row; linked if den * overlap >= num * union."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = store(heads(docs, n, num, den, frequent_buckets(docs, n)), "heads")
    first = rows.where("head is not null").select("class", "size", "rare", "head")
    open_ = store(pivots(first.select("rare", "class", "size", F.posexplode("head").alias("place", "col")), num, den), "columns")
    first = first.groupBy("class").agg(F.first("head").alias("head"), F.first("size").alias("size"), F.first("rare").alias("rare"))
    labels = None
    for round_ in range(ROUNDS + 1):
        if round_ == 0:
            pairs = open_.where("pivot is not null").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
        else:
            # Where each row is now; columns within one component are done.
            now = open_.join(labels.withColumnRenamed("node", "class"), "class", "left")
            now = now.select("col", "rare", "class", "size", "place", F.coalesce("comp", "class").alias("comp"))
            pivot = F.min(F.struct("rare", "class", "size", "place", "comp")).alias("p")
            group = now.groupBy("col").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), pivot)
            now = store(now.join(group.where("low <> high").select("col", "n", "p"), "col"), "columns")
            if now.isEmpty():
                break
            small = now if round_ == ROUNDS else now.where(F.col("n") <= SMALL)
            large = now.where("false") if round_ == ROUNDS else now.where(F.col("n") > SMALL)
            x, y = small.alias("x"), small.alias("y")
            both = (F.col("x.col") == F.col("y.col")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.comp") != F.col("y.comp"))
            direct = x.join(y, both & reachable("x.size", "x.place", "y.size", "y.place", num, den))
            direct = direct.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
            star = large.where((F.col("comp") != F.col("p.comp")) & reachable("p.size", "p.place", "size", "place", num, den))
            pairs = direct.union(star.select("p.class", "class"))
            open_ = large.where(F.col("class") != F.col("p.class")).select("col", "rare", "class", "size", "place")
        pairs = store(promising(pairs.distinct(), first, num, den), "pairs")
        if labels is not None and pairs.isEmpty():
            continue
        sets = sets_of(docs, n, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        links = store(verified(pairs, sets, num, den), "links")
        if labels is None:
            labels = components(links)
        elif not links.isEmpty():
            # Only components are linked anew; their old labels lead to the new ones.
            moved = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(
                labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left"
            )
            moved = moved.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
            fresh = components(moved)
            old = labels.join(fresh.toDF("comp", "further"), "comp", "left").select("node", F.coalesce("further", "comp").alias("comp"))
            alone = fresh.join(labels.select("node"), "node", "left_anti")
            labels = store(old.union(alone), "labels")
    classes = rows.where("id is not null and class is not null").groupBy("class").agg(F.min("id").alias("root"))
    placed = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    roots = placed.groupBy("comp").agg(F.min("root").alias("component_id"))
    where = placed.join(roots, "comp").select("class", "component_id")
    done = rows.select("id", "size", "class").join(where, "class", "left")
    # Empty sets are alone; rows without an id have no component.
    return done.select("id", "size", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component of near copies, that with the smallest ``doc_id`` (nulls last).

    Every row counts by itself, also where ids repeat or are null. Of rows of one component that have the same
    id, the hash of the text decides, then the place in the input. Rows without a word are in no component and
    all stay.
    """
    # Stored, so that each row keeps its key however often the input is read.
    keyed = numbered(docs).withColumn("row", F.monotonically_increasing_id())
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = store(keyed, "rows")
    found = jaccard_components(rows, n, num, den, "row", text_col).select(F.col("id").alias("row"), "component_id")
    rank = F.struct(F.col(id_col).isNull(), id_col, F.xxhash64(text_col), "row").alias("rank")
    first = found.join(rows.select("row", rank), "row").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return rows.join(first.select("rank.row"), "row", "left_semi").drop("row").toDF(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


DIGESTS_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
     o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
     r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id
"""

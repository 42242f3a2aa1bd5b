"""A table of distinct text chunks and their token ids.

When no token can reach over a chunk's edge, a text's ids are the ids of its chunks in turn. Each
distinct chunk is then encoded once, and a text's ids are gathered by the positions of its chunks.
The table lives in the task: shuffling every word of a corpus to one shared table and its ids back
would move several times the corpus, while words repeat so much that a task's own table is hit
nearly as often. It starts anew beyond ``limit`` chunks, so its memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Places(dict):
    """Chunk -> place; an unknown chunk gets the next place."""

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        return place


class ChunkTable:
    """``encode`` maps new chunks to their ids in turn and the number of ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 100_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def places(self, chunks: list[str]) -> np.ndarray:
        """The table's entry of each chunk; unknown ones are encoded first.

        Places hold until the next call.
        """
        if len(self.place) > self.limit:
            self.clear()
        known = len(self.place)
        found = np.fromiter(map(self.place.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if len(self.place) > known:
            ids, lengths = self.encode(list(self.place)[known:])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return found

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in turn, and how many ids each chunk has."""
        starts, lengths = self.starts[places], self.starts[places + 1] - self.starts[places]
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)
        return self.ids[at], lengths


class WordTable:
    """The same for chunks that stay in Arrow, which takes a tenth of the memory of a table of Python strings.

    ``encode`` maps new chunks to their numbers in an order of its own, their ids in turn and the number of ids
    of each. A lookup goes through the whole table, so it is meant for many chunks at a time.
    """

    def __init__(self, encode: Callable, limit: int = 1_000_000, limit_bytes: int = 32 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int32)

    def places(self, chunks: pa.StringArray) -> np.ndarray:
        """The table's entry of each chunk; unknown ones are encoded first.

        Places hold until the next call.
        """
        if len(self.chunks) > self.limit or self.chunks.nbytes > self.limit_bytes or self.ids.nbytes > 2 * self.limit_bytes:
            self.clear()
        found = pc.index_in(chunks, value_set=self.chunks)
        places = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if found.null_count:
            missing = found.is_null()
            new = chunks.filter(missing).dictionary_encode()
            order, ids, lengths = self.encode(new.dictionary)
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(self.chunks), len(self.chunks) + len(order))
            places[missing.to_numpy(zero_copy_only=False)] = place[new.indices.to_numpy()]
            self.chunks = pa.concat_arrays([self.chunks, new.dictionary.take(pa.array(order))])
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int32)])
        return places

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in turn, and how many ids each chunk has."""
        lists = pa.ListArray.from_arrays(pa.array(self.starts), pa.array(self.ids)).take(pa.array(places))
        return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def in_order(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of all chunks in turn, from groups of (chunk numbers, ids, lengths)."""
    numbers, ids, lengths = (np.concatenate([g[i] for g in groups]) for i in range(3))
    ends = np.cumsum(lengths)
    order = np.argsort(numbers, kind="stable")
    kept = lengths[order]
    at = np.arange(len(ids)) + np.repeat((ends - lengths)[order] - (np.cumsum(kept) - kept), kept)
    return ids[at], kept


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; ``counts`` has the length of each run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]

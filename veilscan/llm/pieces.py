"""SentencePiece encoding and decoding by a table of distinct marked words.

A text is normalised by the model itself, which turns spaces into the marker U+2581 and puts one in
front. If no piece has a marker after another character, no piece can reach over the edge between a
word and the markers of the next. Then a text is cut into chunks of markers and the word after them,
every distinct chunk is segmented once (see ``chunks.py``), and ids join back by position. Decoding
works on the same table: a chunk's text is decoded once and joined by position.

Rows without a text count as empty texts: no ids, and an empty decoded text. Rows are encoded each by itself, so
repeated rows give the same ids again. Input columns named ``ids`` or ``decoded`` give way to the results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.chunks import ChunkTable, in_order, sums
from veilscan.llm.common import byte_slices, give_back, list_column, small_batches

MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


#: Chunks that the model is given at once.
GROUP = 64


class PieceCodec:
    """One model with its chunk table, kept by each Python worker."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if crossing := [p for p in pieces if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces cross a whitespace marker, e.g. {crossing[0]!r}")
        if self.model.normalize("a") != f"{MARK}a" or self.model.normalize(" a ") != f"{MARK * 2}a{MARK}":
            raise ValueError("the model must put one marker in front and keep white space")
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.mark_id = self.model.piece_to_id(MARK)
        self.table = ChunkTable(self.encode)
        self.decoded: list[str] = []

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks; their decoded texts go to ``self.decoded``."""
        if len(self.decoded) + len(chunks) > len(self.table.place):
            self.decoded = []
        texts: list[str] = [""] * len(chunks)
        groups = []
        # Chunks of one marker are given to the model many at a time, joined by spaces; each of
        # them starts at the only marked piece that it has.
        plain = [i for i, c in enumerate(chunks) if len(c) > 1 and c.count(MARK) == 1 and c[0] == MARK]
        for at in range(0, len(plain), GROUP):
            own = plain[at : at + GROUP]
            ids = self.model.encode(" ".join([chunks[i][1:] for i in own]))
            flat = np.array(ids, dtype=np.int32)
            starts = np.flatnonzero(self.marked[flat])
            groups.append((np.array(own), flat, np.diff(starts, append=len(flat))))
            for i, text in zip(own, self.model.decode(ids).split(" "), strict=True):
                texts[i] = " " + text
        for i in sorted(set(range(len(chunks))) - set(plain)):
            # The model itself puts one marker in front of what it is given.
            ids = self.model.encode(chunks[i][1:]) if len(chunks[i]) > 1 else [self.mark_id]
            groups.append((np.array([i]), np.array(ids, dtype=np.int32), np.array([len(ids)])))
            texts[i] = " " + self.model.decode(ids)
        self.decoded += texts
        return in_order(groups)

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in turn, the number of ids of each text, and the decoded texts."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(self.model.normalize(texts)):
            own = cut(text)
            counts[i] = len(own)
            chunks += own
        places = self.table.places(chunks)
        ids, lengths = self.table.gather(places)
        parts, ends = list(map(self.decoded.__getitem__, places.tolist())), np.cumsum(counts)
        return ids, sums(lengths, counts), ["".join(parts[e - n : e])[1:] for e, n in zip(ends, counts, strict=True)]


def cut(text: str) -> list[str]:
    """A normalised text in chunks: markers, and what follows up to the next marker."""
    if MARK * 2 in text or "\x01" in text:
        return CHUNKS.findall(text)
    return text.replace(MARK, f"\x01{MARK}").split("\x01")[1:]


@lru_cache(maxsize=4)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` after its columns (an equal name of an input column gives way)."""
    small_batches(docs.sparkSession)
    kept = docs.drop("ids", "decoded")
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    )
    at = kept.columns.index(text_col)

    def run(batches):
        own = codec(model_path)
        for whole in batches:
            for batch in byte_slices(whole, at):
                ids, lengths, decoded = own.run([t or "" for t in batch.column(at).to_pylist()])
                columns = [*batch.columns, list_column(ids, lengths, pa.int32()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        own.table.clear()
        own.decoded = []
        give_back()

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    done = encode_decode(docs.select("doc_id", "text"), model_path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Token-ID output: documents as id lists in Parquet files made for selective reads.

Files hold ``doc_id, shard, before, n_tokens, ids`` in ascending ``doc_id`` order (nulls first, ties by
text). A shard is one range of ids; ``before`` counts the ids of the shard before the document. Ids are
dictionary-coded, the ascending and counting columns delta-coded; row groups and pages are small and
have a page index, so a reader of some documents or of counts alone touches few pages. A side table has
each shard's first position, so that a document starts at its shard's position plus ``before``.

Rows without a text count as empty texts: they hold the end id alone. Repeated rows are all written. Columns other
than ``doc_id`` and ``text`` are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.chunks import WordTable, sums
from veilscan.llm.common import give_back, list_column, pooled, shared_folder, single_thread, small_batches

#: Before a single space between two characters that are no white space, every pre-tokenizer of the
#: byte-level kind starts a new token; so texts may be cut there.
EDGE = re.compile(r"(?<=\S)(?= \S)")
#: Texts with a space at an end or beside other white space.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = f"^ | $|{BLANK} | {BLANK}"

#: A space and a word without white space at its end, nor a "<", with which added tokens start.
PLAIN = f"^ [^ <]*[^<{BLANK[1:-1]}]$"
#: No white space and no "<" at all.
BARE = f"^[^<{BLANK[1:-1]}]+$"
#: Words that are not cut at line ends: white space beside one, or nothing.
BAD_LINES = f"^\n|\n$|{BLANK}\n|\n{BLANK}"
#: A new token starts between a letter or digit and a full stop or comma; what follows the word is white space.
ENDED = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]$"

#: Chunks that the model is given at once.
GROUP = 256

#: Bytes of text that are cut and numbered together.
SLICE = 24 << 20

SCHEMA = "doc_id long, shard int, before long, n_tokens long, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """Sizes of the files' parts, in bytes and rows."""

    row_group: int = 32 << 20
    page: int = 256 << 10
    page_rows: int = 2_000

    def options(self) -> dict[str, str]:
        return {
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": "true",
        }


class IdEncoder:
    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.table = WordTable(self.encode)
        [self.line] = self.ids(["\n"])[0]
        space = "\u0120"  # how byte-level vocabularies write a space
        self.spaced = np.array([(self.model.id_to_token(i) or "").startswith(space) for i in range(self.model.get_vocab_size())])

    def encode(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers in an order of its own, the ids of these chunks in turn and the number of ids of each."""
        # Chunks whose only space is the first character are given to the model many at a time; the
        # first id of each is the only one that stands for a string with a space in front.
        plain = pc.match_substring_regex(chunks, PLAIN)
        bare = pc.match_substring_regex(chunks, BARE)
        ids, lengths, texts = [], [], chunks.filter(plain).to_pylist()
        for at in range(0, len(texts), GROUP):
            flat = np.array(self.ids(["".join(texts[at : at + GROUP])])[0], dtype=np.int32)
            ids.append(flat)
            lengths.append(np.diff(np.flatnonzero(self.spaced[flat]), append=len(flat)))
        # Those without white space are joined by line ends.
        texts = chunks.filter(bare).to_pylist()
        for at in range(0, len(texts), GROUP):
            flat = np.array(self.ids(["\n".join(texts[at : at + GROUP])])[0], dtype=np.int32)
            ends = np.flatnonzero(flat == self.line)
            ids.append(np.delete(flat, ends))
            lengths.append(np.diff(ends, prepend=-1, append=len(flat)) - 1)
        for own in self.ids(chunks.filter(pc.invert(pc.or_(plain, bare))).to_pylist()):
            ids.append(np.array(own, dtype=np.int32))
            lengths.append(np.array([len(own)]))
        kind = np.where(plain.to_numpy(zero_copy_only=False), 0, np.where(bare.to_numpy(zero_copy_only=False), 1, 2))
        return np.argsort(kind, kind="stable"), np.concatenate(ids), np.concatenate(lengths)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def run(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each with the end id behind it, and how many ids each text has.

        Evenly spaced texts are cut and their words numbered by Arrow, so only the distinct words are looked
        up; the others are cut one by one.
        """
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~odd)
        words = pc.split_pattern(texts.take(pa.array(rows)), " ")
        first = words.offsets.to_numpy()[:-1]
        counts = np.diff(words.offsets.to_numpy()).astype(np.int64)
        coded = words.values.dictionary_encode()
        heads = words.values.take(pa.array(first))
        cut = [EDGE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        single = pa.concat_arrays([heads, pa.array([c for own in cut for c in own], pa.string())])
        number, lists = self.lists(coded.dictionary, single)
        own, n_words = number[coded.indices.to_numpy()], len(number)
        own[first] = np.arange(n_words, n_words + len(heads))
        all_counts = np.zeros(len(texts), dtype=np.int64)
        all_counts[rows] = counts
        if cut:
            all_counts[odd] = [len(c) for c in cut]
            row = np.concatenate([np.repeat(rows, counts), np.repeat(np.flatnonzero(odd), all_counts[odd])])
            rest = np.arange(n_words + len(heads), len(lists))
            own = np.concatenate([own, rest])[np.argsort(row, kind="stable")]
        taken = lists.take(pa.array(own))
        n = sums(np.diff(taken.offsets.to_numpy()), all_counts)
        return np.insert(taken.flatten().to_numpy(), np.cumsum(n), end_id), n + 1

    def lists(self, words: pa.StringArray, single: pa.StringArray) -> tuple[np.ndarray, pa.ListArray]:
        """The ids of words that follow a space and of single chunks, and the place of each word in this list.

        Words are looked up in parts: lines, and before a full stop or comma.
        """
        space = lambda part: pc.binary_join_element_wise("", part, " ")
        whole = pc.match_substring_regex(words, BAD_LINES).to_numpy(zero_copy_only=False)
        order = np.argsort(whole, kind="stable")
        number = np.empty(len(words), dtype=np.int64)
        number[order] = np.arange(len(words))
        lines = pc.split_pattern(words.filter(pa.array(~whole)), "\n")
        at, parts = lines.offsets.to_numpy(), lines.flatten()
        starts = np.zeros(len(parts), dtype=bool)
        starts[at[:-1]] = True
        ended = pc.match_substring_regex(parts, ENDED)
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(parts, 0, -1), parts)
        stems = pc.if_else(pa.array(starts), space(stems), stems)
        others = pa.concat_arrays([space(words.filter(pa.array(whole))), single])
        places = self.table.places(pa.concat_arrays([stems, others, pa.array(["", "\n", ".", ","])]))
        none, line, stop, comma = places[-4:]
        stopped = pc.ends_with(parts, ".").to_numpy(zero_copy_only=False)
        ended = ended.to_numpy(zero_copy_only=False)
        tails = np.where(ended, np.where(stopped, stop, comma), none)
        threes = np.stack([np.where(starts, none, line), places[: len(parts)], tails], axis=1)
        ids, lengths = self.table.gather(np.concatenate([threes.ravel(), places[len(parts) : -4]]))
        n = sums(lengths, np.concatenate([3 * np.diff(at), np.ones(len(others), dtype=np.int64)]))
        return number, list_column(ids, n, pa.int32())


@lru_cache(maxsize=4)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, layout: Layout = Layout()) -> None:
    """Encode ``doc_id, text`` rows and write the files and the side table below ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    # Ties in doc_id are ordered by text, which also lets a range split a much repeated id.
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = ranged.repartitionByRange(F.asc_nulls_first("doc_id"), "tie")
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").withColumn("shard", F.spark_partition_id())

    def run(batches):
        own, before = encoder(tokenizer), 0
        for batch in pooled(batches, 1, SLICE):
            ids, n = own.run(batch.column(1).fill_null(""), end_id)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(starts), pa.array(n), list_column(ids, n, pa.int32())],
                names=["doc_id", "shard", "before", "n_tokens", "ids"],
            )
        give_back()

    ranged.mapInArrow(run, SCHEMA).write.options(**layout.options()).parquet(f"{path}/tokens")
    shards = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard: a few bytes for every file.
    first = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.select("shard", F.coalesce(first, F.lit(0)).alias("first"), "n").write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, shard, before, n_tokens, ids`` as written."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, first long, n long").parquet(f"{path}/shards")


def _crc(batches):
    for batch in batches:
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        flat = flat.astype("<u4")
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        rest = [batch.column(c) for c in ("doc_id", "shard", "before", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(crcs, pa.int64())], names=["doc_id", "shard", "before", "n_tokens", "ids_crc32"])


def digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, read them back, and return a digest per document."""
    spark = docs.sparkSession
    path = shared_folder(spark)
    write_tokens(docs, path, tokenizer, end_id)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "shard", "before", "n_tokens", "ids_crc32")])
    kind["shard"].dataType = T.IntegerType()
    # Ids stay where they are read; only the digest rows meet the side table.
    rows = read_tokens(spark, path).mapInArrow(_crc, kind)
    return rows.join(read_shards(spark, path).select("shard", "first"), "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )

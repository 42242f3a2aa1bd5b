"""Files in, text out: binary scan, type by extension, decoding and CSV flattening."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.regex import SPACE
from veilscan.functions.text import has_content, let
from veilscan.operators.scan import scan_rows
from veilscan.params import MIME_EXTENSIONS, ScanParams

# Messages stored for files that give no text.
DOWNLOAD_FAILED = "Download failed (permission denied or not found)"
NO_TEXT = "Text extraction returned empty content"

LOCAL_MIME = {
    ext: mime for mime, ext in MIME_EXTENSIONS.items() if ext in (".txt", ".pdf", ".docx")
}


def mime_of_suffix(suffix: Column) -> Column:
    """Type by file extension, any case; anything unknown is plain text."""
    known = F.create_map(*[F.lit(x) for pair in LOCAL_MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(suffix)), F.lit("text/plain"))


def local_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files directly in ``folder`` with their bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    return (
        raw.withColumn("name", name)
        .withColumn("suffix", suffix)
        .select(
            F.concat(
                F.lit("local_"), F.expr("left(name, length(name) - length(suffix))")
            ).alias("file_id"),
            F.col("name").alias("file_name"),
            F.col("path").alias("file_path"),
            F.lit("local-system").alias("owner"),
            mime_of_suffix(F.col("suffix")).alias("mime_type"),
            F.lit("").alias("modified_time"),
            "content",
        )
    )


def _decoded(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset)
    except UnicodeDecodeError:
        return None


def _table(entries: list) -> Column:
    """A list as one constant of the plan."""
    kind = "array<int>" if all(e is None or isinstance(e, int) for e in entries) else "array<string>"
    return F.from_json(F.lit(json.dumps(entries)), kind)


@functools.cache
def _pairs(charset: str) -> list[str | None]:
    """The character of each pair of bytes from 0x8100 on, asked of the codec once."""
    return [_decoded(code.to_bytes(2), charset) for code in range(0x8100, 0x10000)]


@functools.cache
def _jamo(place: int) -> list[int | None]:
    """What each last byte from 0xA1 on adds to a syllable spelled out in eight bytes, at one of its three places."""

    def syllable(byte: int) -> int | None:
        jamo = [0xA1, 0xBF, 0xD4]
        jamo[place] = byte
        text = _decoded(b"\xa4\xd4" + bytes(x for j in jamo for x in (0xA4, j)), "euc-kr")
        return ord(text) - 0xAC00 if text else None

    return [syllable(byte) for byte in range(0xA1, 0xFF)]


# In bytes as Latin-1: single bytes together, pairs, and a syllable spelled out in eight bytes.
PAIRS = r"(?s)[\x00-\x7f]++|[\x80-\xff].?"
SPELLED = r"(?s)\xa4\xd4(?:\xa4.){3}|[\x00-\x7f]++|[\x80-\xff].?"


def _korean(latin: Column, pattern: str, charset: str) -> Column:
    """Text of bytes (given as Latin-1) in a Korean charset, NULL where they are none."""
    at = lambda unit, i: F.ascii(F.substring(unit, i, 1))
    pairs = _table(_pairs(charset))

    def character(unit: Column) -> Column:
        jamo = [F.get(_table(_jamo(place)), at(unit, 4 + 2 * place) - 0xA1) for place in range(3)]
        spelled = F.decode(F.unhex(F.hex((jamo[0] + jamo[1] + jamo[2] + 0xAC00).cast("long"))), "UTF-16BE")
        code = at(unit, 1) * 256 + at(unit, 2)
        return F.when(at(unit, 1) < 0x80, unit).when(F.length(unit) == 8, spelled).when(code >= 0x8100, F.get(pairs, code - 0x8100))

    units = F.transform(F.regexp_extract_all(latin, F.lit(f"({pattern})"), F.lit(1)), character)
    return F.when(~F.exists(units, lambda u: u.isNull()), F.array_join(units, ""))


def plain_text(content: Column) -> Column:
    """UTF-8 as it is; other bytes as one of the Korean charsets, else as Latin-1, which never fails.

    All in built-in expressions: tables of the charsets are constants of the plan.
    """
    text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    other = F.coalesce(_korean(latin, SPELLED, "euc-kr"), _korean(latin, PAIRS, "cp949"), latin)
    return F.when(F.is_valid_utf8(text), text).otherwise(other)


# A cell (quoted with what follows its quotes, or plain) and what ends it. Possessive, so linear.
CELL = r'\G(?:"([^"]*+(?:""[^"]*+)*+)"?([^,\r\n]*+)|((?!")[^,\r\n]*+))(,|\r*+\n|\r*+\z)'
# Two noncharacters that stand for the end of a cell and of a row; texts lose theirs.
CELL_END, ROW_END = "\ufdd0", "\ufdd1"


def flatten_csv(text: Column) -> Column:
    """Cells of a row joined by blanks, rows by line ends; unreadable CSV gives ''.

    Cells are stripped and empty ones left out; a row without any stays as an empty line.
    Unreadable is a carriage return inside a plain cell.
    """
    clean = F.translate(text, CELL_END + ROW_END, "\ufffd\ufffd")
    # Both are used several times over and are no columns of a plan, which would be computed once.
    return let(clean, lambda t: let(_cells(t), lambda read: _flat(t, read)))


def _cells(text: Column) -> Column:
    """``array<struct<whole, body, last>>``: what a cell takes in the text, holds and ends with."""
    group = lambda i: F.regexp_extract_all(text, F.lit(CELL), F.lit(i))

    def cell(whole: Column, body: Column, last: Column) -> Column:
        return F.struct(whole.alias("whole"), body.alias("body"), last.alias("last"))

    bodies = F.zip_with(
        F.zip_with(group(1), group(2), lambda q, t: F.concat(F.replace(q, F.lit('""'), F.lit('"')), t)),
        group(3),
        lambda quoted, plain: F.concat(quoted, plain),
    )
    read = F.zip_with(F.zip_with(group(0), bodies, lambda w, b: F.struct(w.alias("w"), b.alias("b"))), group(4),
                      lambda x, last: cell(x["w"], x["b"], last))
    return F.filter(read, lambda c: c["whole"] != "")


def _flat(text: Column, read: Column) -> Column:
    joined = F.array_join(
        F.transform(
            read,
            lambda c: F.concat(
                F.regexp_replace(c["body"], f"^[{SPACE}]+|[{SPACE}]+\\z", ""),
                F.when(c["last"] == ",", CELL_END).when(F.endswith(c["last"], F.lit("\n")), ROW_END).otherwise(""),
            ),
        ),
        "",
    )
    joined = F.regexp_replace(joined, f"{CELL_END}+", CELL_END)
    joined = F.regexp_replace(joined, f"(?<=^|{ROW_END}){CELL_END}|{CELL_END}(?={ROW_END}|\\z)", "")
    # The last row's end is no further row.
    ended = F.endswith(F.element_at(read, -1)["last"], F.lit("\n"))
    joined = F.when(ended, F.regexp_replace(joined, f"{ROW_END}\\z", "")).otherwise(joined)
    length = F.aggregate(read, F.lit(0), lambda n, c: n + F.length(c["whole"]))
    flat = F.translate(joined, CELL_END + ROW_END, " \n")
    return F.when(text == "", "").when(length < F.length(text), "").otherwise(flat)


def csv_text(content: Column) -> Column:
    return flatten_csv(plain_text(content))


# Which extractor serves which type. PDF and DOCX need a codec of the
# caller's choice: pass ``extractors={**EXTRACTORS, "application/pdf": my_column_function}``.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "text/plain": plain_text,
    "text/csv": csv_text,
    "application/vnd.google-apps.document": plain_text,
    "application/vnd.google-apps.spreadsheet": csv_text,
}


def extract_text(
    files: DataFrame, extractors: Mapping[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """Replace ``content`` by ``text``; NULL where the type is unsupported or no text results."""
    by_extractor: dict[Callable, list[str]] = {}
    for mime, extractor in (extractors or EXTRACTORS).items():
        by_extractor.setdefault(extractor, []).append(mime)
    # Each extractor sees only the bytes of its own types.
    options = [
        extractor(F.when(F.col("mime_type").isin(*mimes), F.col("content")))
        for extractor, mimes in by_extractor.items()
    ]
    return (
        files.withColumn("text", F.coalesce(*options))
        .withColumn("text", F.when(has_content(F.col("text")), F.col("text")))
        .withColumn("_downloaded", F.col("content").isNotNull())
        .drop("content")
    )


def extraction_error(text: Column, downloaded: Column) -> Column:
    return F.when(~downloaded, F.lit(DOWNLOAD_FAILED)).when(~has_content(text), F.lit(NO_TEXT))


def scan_files(
    files: DataFrame,
    params: ScanParams | None = None,
    extractors: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Bytes to per-file results. A file that cannot be read becomes an error row."""
    texts = extract_text(files, extractors)
    failed = extraction_error(F.col("text"), F.col("_downloaded"))
    return scan_rows(texts.withColumn("error", failed).drop("_downloaded"), "text", params)


def scan_local_folder(
    spark: SparkSession, folder: str, pattern: str = "*", params: ScanParams | None = None
) -> DataFrame:
    """Scan the files of one folder. Blank files are clean here, not errors."""
    files = local_files(spark, folder, pattern)
    lossy = F.when(F.col("mime_type") == "text/plain", F.make_valid_utf8(F.col("raw")))
    texts = (
        extract_text(files.withColumn("raw", F.col("content").cast("string")))
        .withColumn("text", F.coalesce("text", lossy))
        .withColumn("error", F.when(F.col("text").isNull(), F.lit(NO_TEXT)))
        .drop("raw", "_downloaded")
    )
    return scan_rows(texts, "text", params)

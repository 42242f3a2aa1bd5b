"""Secret scans by a recursive decoding worklist.

Every text is scanned as it is; these are its base spans. Then its encoded layers are unwrapped: percent
escapes and Unicode escapes are decoded in place over the whole layer, base64 runs become layers of their
own. Each new layer is scanned again and unwrapped in turn, until no new layer comes up. A layer whose text
and place were seen before is not taken again, which ends cycles. Every character of a layer knows the part
of the original text that it stands for, so spans of deep layers come back as spans of the original; a match
in a base64 layer covers the whole run, or its lines in a run of several.

A base64 run goes on over line ends and is decoded from each of its first four characters, so that data
behind other characters of the alphabet (as in a path) is decoded in step. Decoded data is read as Latin-1,
which has all ASCII of UTF-8 too, and as UTF-16 where it alternates with zeros, whatever other bytes are in
it; all patterns are ASCII. gzip and zlib data is inflated wherever it starts, in its turn too: it passes
through as a stream, each level feeding the next, so its size and depth change nothing but the time, with one
exception: an unbroken stretch of more than four ``BLOCK``s in it (32 MB without a comma, bracket or the like)
is looked at in overlapping pieces, and packed data of over 8 MB that is coded in such a stretch may be found
in part only. Broken data is inflated up to the broken byte; an intact member is passed over whole, and what follows it directly
belongs to the same data.

Positions are code points, ends exclusive. Rows without a text (null or empty) have no spans. Rows are judged
each by itself: repeated rows give the same spans again, and spans that start together are listed by kind, then
end. An input column named ``secrets`` gives way to the result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm.common import byte_slices, small_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
BLOCK = 8 << 20  # bytes of inflated data looked at together; it changes no result, see blocks()
FED = 4 << 10  # bytes inflated at once: 4 MB at most come out

# Fixed patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 at least; shorter runs would be dropped

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_NEXT = r"(?:[ \t]*(?:\r\n?|\n)[ \t]*[A-Za-z0-9+/_-]++)"
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}+{_NEXT}*+|[A-Za-z0-9+/_-]++{_NEXT}++)={{0,2}}")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
SHORTEST = 12  # characters of the shortest secret, "token=abcdef"; no encoding of one is shorter or not ASCII
ASCII = re.compile(rb"[\x00-\x7f]{12}")
WIDE = re.compile(rb"(?:[\x01-\x7f]\x00){12,}+|(?:\x00[\x01-\x7f]){12,}+")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
# Bytes that are part of no secret and no encoded run in any layer; the second of two zeros ends UTF-16.
LAST_SAFE = re.compile(rb"""(?s:.*)(?:[^A-Za-z0-9+/_.=\-"':\x20\t\r\n%\\&#;\0]|\0(?=\0))""")

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType(), False),
            T.StructField("kind", T.IntegerType(), False),
            T.StructField("end", T.LongType(), False),
            T.StructField("base", T.BooleanType(), False),
        ]
    ),
    False,
)


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of each secret of one layer."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def percent_chars(run: str) -> list[tuple[str, int]]:
    """Characters of a run of percent escapes, each with its length in the run."""
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        return [(c, 3) for c in raw.decode("latin-1")]


def escape_chars(run: str) -> list[tuple[str, int]]:
    if run[:2] == "\\u":
        text = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        return [("�" if "\ud800" <= c <= "\udfff" else c, 12 if c > "￿" else 6) for c in text]
    if run[0] == "\\":
        return [(chr(int(run[2:], 16)), 4)]
    code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    return [(chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", len(run))]


class Layer:
    """A text, and for each character the first and last end of its place in the original, or one place for all."""

    def __init__(self, text: str, starts: np.ndarray | int, ends: np.ndarray | int):
        self.text, self.starts, self.ends = text, starts, ends
        self.one = not isinstance(starts, np.ndarray)

    def key(self) -> bytes:
        first, last = (self.starts, self.ends) if self.one else (self.starts[0], self.ends[-1])
        return hashlib.blake2b(f"{first}:{last}:".encode() + self.text.encode(), digest_size=16).digest()

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.one:
            return self.starts, self.ends
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def rewritten(self, pattern: re.Pattern, chars) -> Layer | None:
        """This layer with all matches decoded in place, None if there are none."""
        if self.one:
            text = pattern.sub(lambda m: "".join(c for c, _ in chars(m.group())), self.text)
            return None if text == self.text else Layer(text, self.starts, self.ends)
        text, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            starts.append(self.starts[at : m.start()])
            ends.append(self.ends[at : m.start()])
            decoded = chars(m.group())
            widths = np.array([w for _, w in decoded])
            last = m.start() + np.cumsum(widths)
            text.append("".join(c for c, _ in decoded))
            starts.append(self.starts[last - widths])
            ends.append(self.ends[last - 1])
            at = m.end()
        if not at:
            return None
        text.append(self.text[at:])
        return Layer("".join(text), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]))


def fed(z, data: memoryview) -> tuple[list[bytes], int]:
    """What ``z`` makes of ``data`` up to its end or the first broken byte, and how many bytes were taken."""
    before = z.copy()
    try:
        return [z.decompress(data)], len(data) - len(z.unused_data)
    except zlib.error:
        pass
    out, at, size = [], 0, len(data) // 2
    while size:
        trial = before.copy()
        try:
            out.append(trial.decompress(data[at : at + size]))
            before, at = trial, at + size
            size = min(size, len(data) - at)
        except zlib.error:
            size //= 2
    return out, at


class Members:
    """gzip and zlib members that follow each other from ``start`` on, inflated as their bytes come in.

    ``end`` is where the bytes taken so far end, ``free`` the first place that no intact member covers.
    """

    def __init__(self, start: int):
        self.start = self.end = self.free = start
        self.z, self.head, self.over, self.digest = None, b"", False, None

    def feed(self, data: memoryview) -> Iterator[bytes]:
        at = 0
        while at < len(data) and not self.over:
            if self.z is None:  # the signature of a member may come in several pieces
                at += 1
                self.head += data[at - 1 : at]
                if PACKED.match(self.head):
                    self.z, self.free, head = zlib.decompressobj(47), self.end + 1, self.head
                    self.head = b""
                    yield from self.part(head)
                elif len(self.head) == 3:
                    self.over = True
            else:
                piece = data[at : at + FED]
                taken = yield from self.part(piece)
                at += taken

    def part(self, piece: memoryview | bytes) -> Iterator[bytes]:
        out, taken = fed(self.z, piece)
        yield from filter(None, out)
        self.end += taken
        if self.z.eof:
            self.z, self.free = None, self.end
        else:
            self.over = taken < len(piece)
        return taken

    def sign(self, data: memoryview) -> None:
        """Takes ``data`` and keeps nothing but a digest of the inflated bytes, None as long as there are none."""
        for out in self.feed(data):
            self.digest = self.digest or hashlib.blake2b(digest_size=16)
            self.digest.update(out)


#: Data as pieces in order; they can be asked for again.
Pieces = Callable[[], Iterable[bytes]]


def inflated(data: Pieces, start: int) -> Iterator[bytes]:
    """Inflated pieces of the members of ``data`` that begin at ``start``."""
    members, before = Members(start), 0
    for piece in data():
        if before + len(piece) > start:
            yield from members.feed(memoryview(piece)[max(0, start - before) :])
        if members.over:
            return
        before += len(piece)


def packed(data: Pieces) -> list[tuple[int, int, bytes]]:
    """(start, end, digest of the inflated bytes) of all packed data in ``data``.

    It may start at every signature outside of intact members; a broken one is taken as far as it goes.
    """
    tried: list[Members] = []
    live: list[Members] = []
    tail, before, free = b"", 0, 0
    for piece in data():
        for members in live:
            members.sign(memoryview(piece))
        seen, first, at = tail + piece, before - len(tail), 0
        while m := PACKED.search(seen, at):
            start, at = first + m.start(), m.start() + 1
            free = max([free, *(x.free for x in live)])
            if start < free:
                at = max(at, min(free - first, len(seen)))
            elif m.end() > len(tail):  # others were tried with the piece before
                members = Members(start)
                members.sign(memoryview(seen)[m.start() :])
                tried.append(members)
                live.append(members)
                free = max(free, members.free)
                live = [x for x in live if not x.over]
        tried = [x for x in tried if x.digest or not x.over]
        before += len(piece)
        tail = seen[-2:]
    found, free = [], 0
    for members in tried:
        if members.start >= free and members.digest:
            found.append((members.start, members.end, members.digest.digest()))
            free = max(free, members.free)
    return found


def blocks(data: Pieces) -> Iterator[bytes]:
    """``data`` in blocks of about ``BLOCK`` bytes, cut where no secret and no encoded run can go on.

    Only a stretch of more than four blocks without such a place is cut in its midst, with a block of overlap.
    """
    kept = bytearray()
    for piece in data():
        kept += piece
        if len(kept) < BLOCK:
            continue
        if m := LAST_SAFE.match(kept, max(0, len(kept) - len(piece) - 1)):
            cut = m.end()
            del m
            yield bytes(kept[:cut])
            del kept[:cut]
        elif len(kept) > 4 * BLOCK:
            yield bytes(kept)
            del kept[:-BLOCK]
    if kept:
        yield bytes(kept)


def inflated_layers(data: Pieces, place: Callable[[int, int], tuple[int, int]], known: set) -> Iterator[Layer]:
    """Layers of all packed data in ``data``, nested ones too, however large: nothing is held but one block per level.

    Data whose digest was ``known`` at its place is not taken again, which ends cycles.
    """
    levels = [(data, packed(data)[::-1], place)]
    while levels:
        data, hits, place = levels.pop()
        if not hits:
            continue
        start, end, digest = hits.pop()
        if hits:
            levels.append((data, hits, place))
        first, last = place(start, end)
        if (first, last, digest) in known:
            continue
        known.add((first, last, digest))
        inner: Pieces = functools.partial(inflated, data, start)
        held = bytearray()
        for piece in inner():
            held += piece
            if len(held) > BLOCK:
                break
        else:  # small enough to be inflated once
            inner = functools.partial(iter, [bytes(held)])
        del held
        here = functools.partial(lambda first, last, *_: (first, last), first, last)
        for block in blocks(inner):
            yield from ascii_layers(block, here)
        levels.append((inner, packed(inner)[::-1], here))


def ascii_layers(data: bytes, place: Callable[[int, int], tuple[int, int]]) -> Iterator[Layer]:
    """``data`` as Latin-1, if a secret fits in it, and its stretches of UTF-16."""
    if ASCII.search(data):
        yield Layer(data.decode("latin-1"), *place(0, len(data)))
    for w in WIDE.finditer(data):
        yield Layer(w[0].replace(b"\0", b"").decode(), *place(*w.span()))


class Places:
    """Places in the original of the characters of a base64 run: those of the line that they stand in."""

    def __init__(self, layer: Layer, lines: list[tuple[int, int]]):
        places = [layer.place(a, b) for a, b in lines]
        self.starts, self.ends = (np.array(x) for x in zip(*places, strict=True))
        self.till = np.cumsum([b - a for a, b in lines])
        self.one = len(set(places)) == 1

    def of(self, first, last, offset: int):
        """Place of bytes from ``first`` to ``last``, decoded from ``offset`` on."""
        line = lambda at: np.minimum(np.searchsorted(self.till, at, side="right"), len(self.till) - 1)
        return self.starts[line(offset + first * 8 // 6)], self.ends[line(offset + (last * 8 + 7) // 6)]


def base64_layers(layer: Layer, m: re.Match, known: set) -> Iterator[Layer]:
    """Layers of what a base64 run holds."""
    lines = [r.span() for r in RUN.finditer(layer.text, m.start(), m.end())]
    raw = "".join(layer.text[a:b] for a, b in lines).encode().translate(URL_SAFE)
    lines[-1] = lines[-1][0], m.end()
    places = None
    for offset in range(4):
        own = raw[offset : len(raw) - ((len(raw) - offset) % 4 == 1)]
        if len(own) * 3 // 4 < SHORTEST:
            continue
        data = base64.b64decode(own + b"=" * (-len(own) % 4))
        if not ASCII.search(data) and not PACKED.search(data):
            continue
        places = places or Places(layer, lines)

        def place(start: int, end: int) -> tuple[int, int]:
            first, last = places.of(start, end - 1, offset)  # noqa: B023
            return int(first), int(last)

        if ASCII.search(data) and not places.one:
            at = np.arange(len(data))
            yield Layer(data.decode("latin-1"), *places.of(at, at, offset))
            for w in WIDE.finditer(data):
                yield Layer(w[0].replace(b"\0", b"").decode(), *place(*w.span()))
        else:
            yield from ascii_layers(data, place)
        if PACKED.search(data):
            yield from inflated_layers(functools.partial(iter, [data]), place, known)


def unwrapped(layer: Layer, known: set) -> Iterator[Layer]:
    for pattern, chars, sign in ((PERCENT, percent_chars, "%"), (ESCAPES, escape_chars, ("\\", "&#"))):
        if any(s in layer.text for s in sign) and (new := layer.rewritten(pattern, chars)):
            yield new
    for m in BASE64.finditer(layer.text):
        yield from base64_layers(layer, m, known)


def secrets(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans of one text as (start, kind, end, base), in that order."""
    base = set(scan(text))
    found: set[tuple[int, int, int]] = set()
    worklist, seen, known = [], set(), set()
    if "%" in text or "\\" in text or "&#" in text or BASE64.search(text):
        whole = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
        seen.add(whole.key())
        worklist.append(unwrapped(whole, known))
    while worklist:  # of layers still to come: each is made when its turn comes, so that few are held
        layer = next(worklist[-1], None)
        if layer is None:
            worklist.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            for start, kind, end in scan(layer.text):
                first, last = layer.place(start, end)
                found.add((first, kind, last))
            worklist.append(unwrapped(layer, known))
    return sorted([*((*s, True) for s in base), *((*s, False) for s in found - base)])


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: all spans of each text, in order (an input column of that name gives way)."""
    small_batches(docs.sparkSession)
    kept = docs.drop("secrets")
    schema = T.StructType([*kept.schema.fields, T.StructField("secrets", SPANS, False)])
    at = kept.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = ("start", "kind", "end", "base")

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, at):
                spans = [[dict(zip(names, s, strict=True)) for s in secrets(t)] if t else [] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=schema.names)

    return kept.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(text: str, mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end, _ in secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in its texts replaced by ``mark``; nulls and texts without one stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, at):
                texts = [t and masked(t, mark) for t in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: base spans of each kind, a digest of them, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )

"""Operators on documents against plain twins, on edge rows and on the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import EDGE_ROWS, SF_DIR, contamination, documents, jaccard_components
from pyspark.sql import functions as F

from veilscan.llm import common, decontaminate, language, ngram_join, pieces, secrets, tokens
from veilscan.llm.queries import QUERIES, vocabulary

PIECES, BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def rows_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


# Sentence pieces and token files.


def piece_digest(model, text):
    ids = model.encode(text or "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary(PIECES))
    odd = ["a  b ", " a", "  ", "▁", "a▁b ▁▁c", "x\x01y", "a\x01 b", "\x00", "é ﬁ", "<s> </s> <unk>", "a​b\r\n  c", "\U0001f600\U0001f600 z"]
    rows = [(100 + i, t, None) for i, t in enumerate(odd)] + EDGE_ROWS
    got = pieces.digests(documents(spark, rows), vocabulary(PIECES)).collect()
    want = [(i, *piece_digest(model, t)) for i, t, _ in rows]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_pieces_on_the_table(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary(PIECES))
    got = {tuple(r) for r in QUERIES["op10_pieces"](spark, SF_DIR).collect()}
    assert got == {(i, *piece_digest(model, t)) for i, t in rows_of(spark)}


def test_piece_columns_of_the_same_name_give_way(spark):
    done = pieces.encode_decode(documents(spark), vocabulary(PIECES))
    assert done.columns.count("ids") == 1 and dict(done.dtypes)["ids"] == "array<int>"


def test_piece_table_starts_anew(spark):
    codec = pieces.PieceCodec(vocabulary(PIECES))
    codec.table.limit = 3
    for text in ("a b c d e", "f g", "a b  c h"):
        ids, counts, decoded = codec.run([text, ""])
        assert ids.tolist() == codec.model.encode(text) and counts.tolist() == [len(ids), 0]
        assert decoded == [text, ""]


def token_digests(rows):
    from tokenizers import Tokenizer

    model, at, out = Tokenizer.from_file(vocabulary(BPE)), 0, []
    for id_, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((id_, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_the_library(spark):
    got = [tuple(r) for r in QUERIES["op3_token_files"](spark, SF_DIR).collect()]
    assert sorted(got) == token_digests(sorted(rows_of(spark)))


def test_token_files_of_odd_texts(spark):
    odd = [
        "a  b ", " a", "a\n b", "a\n\n b c", "it's <|endoftext|> so", "x <|endoftext|>y z", "\t", "a\x01b c", "a \x1c b", "　 x",
        "a b c  d", "1 2  3", "☃ ☃", "", None,
    ]
    rows = [(i, t, None) for i, t in enumerate(odd)]
    got = [tuple(r) for r in tokens.digests(documents(spark, rows), vocabulary(BPE)).collect()]
    assert sorted(got) == token_digests([(i, t) for i, t, _ in rows])


def test_token_table_starts_anew(spark):
    own = tokens.IdEncoder(vocabulary(BPE))
    own.table.limit = 3
    lines = ["a.\nb, c.\n", "a\n\nb c,\r\nd", "a.) b., 'c's.\n<|endoftext|>\nd e, x\n\ty", "of,\nand\nthe 1.5, 2.\n.\n"]
    for texts in (["a b c d e", "", "f  g "], ["f g", "x <|endoftext|> y", "a b"], lines, ["", " "], ["a b c d e"]):
        ids, n = own.run(pa.array(texts), 2)
        expected = [[*own.model.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == [i for e in expected for i in e] and n.tolist() == [len(e) for e in expected]


def test_token_table_keeps_many_words(spark):
    own, given = tokens.IdEncoder(vocabulary(BPE)), []
    plain = own.ids
    own.ids = lambda texts: given.append(sum(t.count(" ") for t in texts)) or plain(texts)
    half = [" ".join(f"w{i}" for i in range(a, a + 160_000)) for a in (0, 160_000)]
    first = own.run(pa.array(half[:1]), 2)[0]
    own.run(pa.array(half[1:]), 2)
    assert 319_000 < sum(given) <= 320_000
    assert (own.run(pa.array(half[:1]), 2)[0] == first).all() and sum(given) <= 320_000


def test_pooled_batches():
    texts = ["ab", None, "", "abcdefgh" * 40, "c", "d" * 30, None]
    rows = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["k", "text"])
    got = list(common.pooled(iter([rows.slice(0, 0), rows.slice(0, 3), rows.slice(3, 1), rows.slice(4, 3)]), 1, 200))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert [b.num_rows for b in got] == [3, 1, 3] and not list(common.pooled(iter([]), 1, 200))


def test_token_files_of_edge_rows(spark):
    got = [tuple(r) for r in tokens.digests(documents(spark), vocabulary(BPE)).collect()]
    assert len(got) == len(EDGE_ROWS)
    starts = sorted((r[1], r[2]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((r[0] for r in EDGE_ROWS), key=lambda x: (x is not None, x))


def test_token_files_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    tokens.write_tokens(documents(spark), str(tmp_path / "t"), vocabulary(BPE), 2)
    file = next(f for f in sorted((tmp_path / "t/tokens").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in by_name["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in by_name["n_tokens"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in by_name.values())


# Jaccard join.


def test_join_on_the_table(spark):
    got = sorted(tuple(r) for r in QUERIES["op2_ngram_join"](spark, SF_DIR).collect())
    assert got == sorted(jaccard_components(rows_of(spark)))


def test_join_of_edge_rows(spark):
    docs = documents(spark)
    got = [tuple(r) for r in ngram_join.jaccard_components(docs).collect()]
    assert sorted(map(key, got)) == sorted(map(key, jaccard_components([(i, t) for i, t, _ in EDGE_ROWS])))


def near_copies(seed):
    """Groups of near copies, a passage in most texts, chains, and short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([2, 5, 120])):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(own)
    for _ in range(100):
        rows.append([rng.choice(words) for _ in range(rng.randint(1, 150))] + passage)
    for _ in range(60):
        rows.append([rng.choice(words[:3]) for _ in range(rng.randint(1, 9))])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_join_of_near_copies(spark, monkeypatch, n, num):
    # Small limits, so that pivots and several rounds come up.
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 2)
    rows = near_copies(num)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs, n, num, 100).collect())
    assert got == sorted(jaccard_components(rows, n, num, 100))


def test_join_of_an_empty_table(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    assert ngram_join.deduplicated(documents(spark, [])).count() == 0


def test_deduplicated(spark):
    kept = ngram_join.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted((i is not None, i) for i in (1, 3, 4, 5, 6, None, 7, 8, 9))


def test_deduplicated_rows_not_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(7, x, "a"), (7, y, "b"), (3, x, "c"), (None, z, "d"), (None, z, "e"), (None, x, "f"), (8, z + " end", "g"), (None, "alone", "h"), (None, "alone", "i")]
    for order in (rows, rows[::-1]):
        kept = ngram_join.deduplicated(documents(spark, order).repartition(3)).collect()
        assert sorted(((r.doc_id or 0, r.text) for r in kept)) == [(0, "alone"), (3, x), (7, y), (8, z + " end")]


def test_block_codes():
    rng = np.random.default_rng(1)
    for top in (10, 2**20, 2**36):
        values = np.sort(rng.integers(0, top, 1000).astype(np.uint64))
        assert (ngram_join.decoded(ngram_join.coded(values)) == values.astype(np.int64)).all()


def test_overlap_bounds():
    rng = np.random.default_rng(2)
    xs, ys = [], []
    for _ in range(200):
        base = rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64)
        x, y = (np.unique(base[rng.random(len(base)) < 0.95]) for _ in range(2))
        xs.append(x)
        ys.append(y)
    flat = lambda lists: (np.concatenate(lists), np.array([len(x) for x in lists]))
    got = ngram_join.overlaps(flat(xs), flat(ys), 85, 100)
    both = [len(np.intersect1d(x, y)) for x, y in zip(xs, ys)]
    want = [100 * o >= 85 * (len(x) + len(y) - o) for o, x, y in zip(both, xs, ys)]
    assert got.tolist() == want


def test_components_of_a_chain(spark):
    links = spark.range(40).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 100L AS a, 90L AS b"))
    got = {r.node: r.comp for r in ngram_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


# Decontamination.


def decontaminated(df):
    hits = lambda r: sum(s["end"] - s["start"] for s in r.runs)
    return sorted(key((r.doc_id, r.n_words, hits(r), tuple(r["items"]))) for r in df.collect())


ITEMS = [(1, "quick brown fox jumps over the lazy dog and runs far away"), (2, "Café ☃"), (10, "one"), (3, None), (4, ""), (5, "no such words in it at all, not here nor there"), (6, "!!")]


@pytest.mark.parametrize("max_windows", [500_000, 2])
def test_contamination_of_edge_rows(spark, max_windows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    done = decontaminate.contamination(docs, bench, max_windows=max_windows)
    assert decontaminated(done) == sorted(map(key, contamination([(i, t) for i, t, _ in EDGE_ROWS], ITEMS)))
    row = done.where("doc_id = 9").first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["café ☃"]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {3, 4, 5, 6, None, 7}


def test_contamination_on_the_table(spark):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = decontaminated(decontaminate.contamination(docs, bench, shard_bytes=50_000))
    assert got == sorted(map(key, contamination(rows_of(spark), items)))
    digest = {r.doc_id: r for r in QUERIES["op4_decontamination"](spark, SF_DIR).collect()}
    for id_, n_words, n_hit, found in contamination(rows_of(spark), items):
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(digest[id_]) == (id_, n_words, n_hit, len(found), sha, n_hit > 0)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark), bench).where("size(runs) > 0").count() == 0
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0


def test_index_finds_all_places():
    rng = np.random.default_rng(3)
    for sigma in (2, 5, 300):
        lengths = rng.integers(0, 60, 12)
        docs = [rng.integers(1, sigma + 1, n) for n in lengths]
        docs[3] = docs[2].copy()
        ends = np.cumsum([len(d) + 1 for d in docs]) - 1
        text = np.concatenate([np.append(d, 0) for d in docs])
        index = decontaminate.Index(text.copy(), ends, sigma + 1, step=4)
        phrases = np.full((40, 3), -1)
        for line in phrases:
            n = rng.integers(1, 4)
            line[3 - n :] = rng.integers(1, sigma + 1, n)
        found = dict(zip(*(lambda own, low, high: (own.tolist(), zip(low, high)))(*index.search(phrases))))
        for i, line in enumerate(phrases):
            own = line[line >= 0]
            want = [p for p in range(len(text) - len(own) + 1) if (text[p : p + len(own)] == own).all()]
            got = sorted(index.locate(np.arange(*found[i])).tolist()) if i in found else []
            assert got == want


# Language.


def test_language_of_the_table(spark):
    got = QUERIES["op5_language"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_of_edge_rows(spark):
    got = {r.doc_id: r for r in language.predictions(documents(spark)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 7}
    assert all(got[i].score == 0 for i in (3, 4, 5, 7)) and got[None].held_out is False
    kept = language.known(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(EDGE_ROWS) - 4


def test_language_without_labels(spark):
    rows = [(i, t, None) for i, t, _ in EDGE_ROWS]
    assert {r.lang_pred for r in language.predictions(documents(spark, rows)).collect()} == {"und"}
    assert language.predictions(documents(spark, [])).count() == 0


def test_rows_stay_without_labels(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0][:5]
    unlabelled, only_held = [(i, t, None) for i, t, _ in EDGE_ROWS], [(i, t, "en") for i, t in zip(held, ("some text", "é", "", None, "12 !"))]
    for rows, n in ((unlabelled, len(EDGE_ROWS) - 4), (only_held, 2)):
        kept = language.known(documents(spark, rows))
        assert kept.columns == documents(spark).columns and kept.count() == n
        assert all(r.text and any(map(str.isalpha, r.text)) for r in kept.collect())


def test_language_within_families():
    samples = {
        "en": "the house and the garden with this that which", "de": "das haus und der garten mit diesem welcher nicht",
        "nl": "het huis en de tuin met deze welke niet", "es": "la casa y el jardín con este que los", "fr": "la maison et le jardin avec ce que les",
    }
    rng = random.Random(4)
    text = lambda lang: " ".join(rng.choices(samples[lang].split(), k=30))
    langs = np.array([lang for lang in samples for _ in range(20)], dtype=object)
    model = language.train(np.vstack([language.vector(text(lang)) for lang in langs]), langs)
    assert model.langs == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"]}
    names, score = model.predict(np.vstack([language.vector(text(lang)) for lang in langs]))
    assert names == list(langs) and (score > 0.3).all()


def test_vector_does_not_depend_on_steps(monkeypatch):
    text = "Ärger, 12 naïve Füße!! and some more words" * 20
    whole = language.vector(text)
    monkeypatch.setattr(language, "STEP", 7)
    assert np.allclose(whole, language.vector(text))


# Secrets.


def test_secrets_on_the_table(spark):
    import re

    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in QUERIES["op7_secrets"](spark, SF_DIR).collect()}
    for id_, text in rows_of(spark):
        text = text or ""
        own = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(own))
        counts = tuple(sum(k == kind for _, k, _ in own) for kind in range(3))
        assert tuple(got[id_])[1:5] == (*counts, hashlib.sha256(joined.encode()).hexdigest())


def test_secret_layers():
    import base64
    import gzip
    from urllib.parse import quote

    secret = "password=hunter2hunter2"
    found = lambda t: [(t[a:b], k, base) for a, k, b, base in secrets.secrets(t)]
    assert found(f"x {secret} y") == [(secret, 0, True)]
    hidden = "".join(f"%{ord(c):02x}" for c in secret)
    assert found(f"é {hidden} y") == [(hidden, 0, False)]
    twice = quote(hidden)
    assert found(f"é {twice} y") == [(twice, 0, False)]
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    assert found(f"a {escaped})") == [(escaped, 0, False)]
    packed = base64.b64encode(secret.encode()).decode()
    assert found(f"é ({packed})") == [(packed, 0, False)]
    zipped = base64.b64encode(gzip.compress(gzip.compress(secret.encode()))).decode()
    assert found(f"é ({zipped})") == [(zipped, 0, False)]
    mixed = quote(base64.b64encode(escaped.encode()).decode(), safe="")
    assert found(f"é {mixed} y")[0][1:] == (0, False)
    assert found("token: abc12") == [] and found("") == []


def test_secret_bombs_and_junk():
    import base64
    import zlib as z

    bomb = base64.b64encode(z.compress(b"\0" * (5 * secrets.BLOCK) + b"token=abcdefgh", 9)).decode()
    assert [(k, base) for _, k, _, base in secrets.secrets(f"a {bomb}")] == [(0, False)]
    for junk in ("%", "%zz %e2%28", "\\ud800\\u", "&#0; &#x110000; &#99999999;", base64.b64encode(b"\x1f\x8b rest of it").decode(), "A" * 17):
        assert isinstance(secrets.secrets(junk), list)


def test_secrets_in_any_base64():
    import base64
    import gzip

    secret = "password=hunter2hunter2"
    coded = lambda data: base64.b64encode(data).decode()
    found = lambda t: [(t[a:b], k, base) for a, k, b, base in secrets.secrets(t)]
    # Any charset, any control bytes.
    for data in (secret.encode("utf-16"), secret.encode("utf-16-be"), b"caf\xe9 " + secret.encode(), b"\x1b[1m\0" + secret.encode() + b"\xff"):
        assert found(f"a ({coded(data)})") == [(coded(data), 0, False)]
    # Out of step behind other characters of the alphabet.
    zipped = coded(gzip.compress(b"some text before it, then " + secret.encode()))
    for run in (coded(secret.encode() + b"!"), coded(secret.encode("utf-16")), zipped):
        for before in ("org/api/", "x-", "ab_", "abcd/e", "k/y"):
            assert found(f"https://x.{before}{run} y") == [(before + run, 0, False)]
    # Over line ends.
    lines = base64.encodebytes(b"x" * 50 + secret.encode() + b"y " * 100).decode()
    assert found(f"see:\n{lines}\nend") == [("\n".join(lines.split("\n")[:2]), 0, False)]
    rng = random.Random(6)
    data = gzip.compress(bytes(rng.choices(b"abcdefghij ", k=400)) + secret.encode())
    for end in ("\n", "\r\n", "\n  "):
        lines = base64.encodebytes(data).decode().strip().replace("\n", end)
        assert found(f"see: {lines}") == [(lines, 0, False)]


def nested_data(rng, depth: int) -> bytes:
    """Random words, secrets and packed, coded or escaped data in each other."""
    import base64
    import gzip
    import zlib as z

    parts = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(9 if depth else 3)
        if kind == 0:
            parts.append(rng.choice([b"password=hunter2hunter2", b"AKIA" + b"Z9" * 10, b"0123456789abcdef" * 2]))
        elif kind < 3:
            parts.append(b" ".join(rng.choice([b"one", b"two,", b"token", b"x\x9c", b"\x1f\x8b\x08"]) for _ in range(rng.randrange(60))))
        else:
            inner = nested_data(rng, depth - 1)
            if kind == 3:
                packed = gzip.compress(inner, rng.choice([0, 6])) + gzip.compress(b"tail")
                parts.append(packed)
            elif kind == 4:
                parts.append(z.compress(inner, rng.choice([0, 9])))
            elif kind == 5:
                parts.append(base64.b64encode(inner))
            elif kind == 6:
                parts.append("".join(f"%{b:02X}" for b in inner).encode())
            elif kind == 7:
                parts.append(gzip.compress(inner)[: -rng.randrange(1, 12)])
            else:
                parts.append(inner.decode("latin-1").encode("utf-16-le"))
        parts.append(rng.choice([b",\n", b"\0\0", b"; ,"]))
    return b"".join(parts)


def plain_secrets(text: str) -> set[tuple[int, int, int]]:
    """All spans by plain recursion over whole layers, each character with a place of its own."""
    import base64
    import re
    import zlib as z

    found, seen = set(), set()

    def members(data: bytes):
        """(start, end, whole inflated data); everything is tried one byte at a time, at the outside of intact members."""
        at = 0
        while at < len(data) - 2:
            if not secrets.PACKED.match(data, at):
                at += 1
                continue
            out, end, free = b"", at, at + 1
            while secrets.PACKED.match(data, end):
                inflate, here = z.decompressobj(47), end
                try:
                    while here < len(data) and not inflate.eof:
                        out += inflate.decompress(data[here : here + 1])
                        here += 1
                except z.error:
                    end = here
                    break
                end = here
                if not inflate.eof:
                    break
                free = end
            if out:
                yield at, end, out
            at = free

    def data_layers(data: bytes, places: list):
        whole = [(data.decode("latin-1"), places)]
        for m in secrets.WIDE.finditer(data):
            a, b = m.span()
            whole.append((m[0].replace(b"\0", b"").decode(), [(places[a][0], places[b - 1][1])] * ((b - a) // 2)))
        for layer in whole:
            visit(*layer)
        for a, b, out in members(data):
            data_once(out, (places[a][0], places[b - 1][1]))

    def data_once(out: bytes, place: tuple):
        if (out, place) not in seen:
            seen.add((out, place))
            data_layers(out, [place] * len(out))

    def visit(text: str, places: list):
        if not text or (text, places[0], places[-1]) in seen:
            return
        seen.add((text, places[0], places[-1]))
        for a, kind, b in secrets.scan(text):
            found.add((min(p for p, _ in places[a:b]), kind, max(q for _, q in places[a:b])))
        for pattern, chars in ((secrets.PERCENT, secrets.percent_chars), (secrets.ESCAPES, secrets.escape_chars)):
            new, at = [], 0
            for m in pattern.finditer(text):
                new += zip(text[at : m.start()], places[at : m.start()], strict=True)
                at = m.start()
                for c, width in chars(m[0]):
                    new.append((c, (places[at][0], places[at + width - 1][1])))
                    at += width
            if at:
                new += zip(text[at:], places[at:], strict=True)
                visit("".join(c for c, _ in new), [p for _, p in new])
        for m in secrets.BASE64.finditer(text):
            raw, own = "", []
            lines = [r.span() for r in re.finditer(r"[A-Za-z0-9+/_-]+", text[: m.end()]) if r.start() >= m.start()]
            for i, (a, b) in enumerate(lines):
                raw += text[a:b]
                till = m.end() if i == len(lines) - 1 else b
                own += [(min(p for p, _ in places[a:till]), max(q for _, q in places[a:till]))] * (b - a)
            for offset in range(4):
                run = raw[offset:]
                run = run[: len(run) - (len(run) % 4 == 1)].replace("-", "+").replace("_", "/")
                if len(run) * 3 // 4 >= 12:
                    data = base64.b64decode(run + "=" * (-len(run) % 4))
                    last = len(own) - 1
                    data_layers(data, [(own[min(last, offset + i * 8 // 6)][0], own[min(last, offset + (i * 8 + 7) // 6)][1]) for i in range(len(data))])

    visit(text, [(i, i + 1) for i in range(len(text))])
    return found | set(secrets.scan(text))


def test_secrets_of_random_nestings(monkeypatch):
    import base64
    import random

    hits = 0
    for seed in range(80):
        rng = random.Random(seed)
        data = nested_data(rng, 4)
        text = rng.choice(["see: ", "é\n", "token "]) + base64.b64encode(data).decode() + rng.choice([" end", "!", ""])
        want = plain_secrets(text)
        hits += len(want)
        for block, step in ((8 << 20, 4 << 10), (2000, 7), (3000, 100)):
            monkeypatch.setattr(secrets, "BLOCK", block)
            monkeypatch.setattr(secrets, "FED", step)
            assert {s[:3] for s in secrets.secrets(text)} == want, (seed, block)
    assert hits > 50


def test_secrets_in_large_inflated_data(monkeypatch):
    """Nested packed data over every edge of a block, and secrets at the edges."""
    import base64
    import gzip
    import random
    import zlib as z

    monkeypatch.setattr(secrets, "BLOCK", 1 << 16)
    coded = lambda data: base64.b64encode(data).decode()
    inner = gzip.compress(random.Random(1).randbytes(1 << 17) + b", password=hunter2hunter2")
    for at in (0, (1 << 16) - 9, (1 << 16) - 1, 1 << 16, (1 << 18) - 9, 1 << 20):
        for secret in (b"password=hunter2hunter2", inner, base64.b64encode(inner)):
            data = b", " * (at // 2) + b"," * (at % 2) + secret + b", " * (1 << 17)
            text = "a " + coded(z.compress(data, 9))
            assert secrets.secrets(text) == [(2, 0, len(text), False)]


def test_many_members_take_linear_time():
    import base64
    import gzip
    import random
    import time

    members = [gzip.compress(random.Random(i).randbytes(800)) for i in range(400)]
    members.append(gzip.compress(b"password=hunter2hunter2"))
    for between in (b"", b", "):
        text = base64.b64encode(between.join(members)).decode()
        start = time.process_time()
        assert secrets.secrets(text) == [(0, 0, len(text), False)]
        assert time.process_time() - start < 2
    deep = b"password=hunter2hunter2"
    for _ in range(1200):
        deep = z_compress(deep)
    text = base64.b64encode(deep).decode()
    assert secrets.secrets(text) == [(0, 0, len(text), False)]


def z_compress(data: bytes) -> bytes:
    import zlib as z

    return z.compress(data, 1)


def test_secrets_of_edge_rows(spark):
    got = secrets.digests(documents(spark)).collect()
    assert len(got) == len(EDGE_ROWS) and {r.spans for r in got} == {""}
    text = "say password=abcdefgh and AKIA" + "A" * 20 + " é"
    done = secrets.redacted(documents(spark, [(1, text, None), (2, None, None)]))
    assert done.columns == documents(spark).columns
    assert {r.doc_id: r.text for r in done.collect()} == {1: "say [secret] and [secret] é", 2: None}
    assert secrets.digests(documents(spark, [])).count() == 0


def test_every_document_once(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op2_ngram_join", "op3_token_files", "op4_decontamination", "op5_language", "op7_secrets", "op10_pieces"):
        assert QUERIES[name](spark, SF_DIR).select(F.countDistinct("doc_id")).first()[0] == n

"""Pages, conversations, vectors, the pipeline and the registration."""

import gzip
import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from cases import SF_DIR, documents
from compare import compare, oracle_connection

from veilscan.llm import chat, topk, warc
from veilscan.llm.html import extract, visible_text
from veilscan.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.mark.parametrize("name", list(ORACLES))
@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_queries_against_sql(spark, name, sf_dir):
    problem, n, _, _ = compare(spark, oracle_connection(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert problem is None and n > 0


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


# HTML.

HTML = {
    "<p>a<p>b<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>c": "a\n\nb\n\n- x\n- y\n  3. 1\n  4. 2\n\nc",
    "<table><tr><th>a<th>long head<tr><td>bb<td>c</table>t": "a  | long head\nbb | c\n\nt",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one<td>z</table>": "a | b\n  | c".replace("  | c", "    c") + "\nwide one | z",
    "<table><tr><td>one<br>two<td>x</table>": "one | x\ntwo",
    "a<br>b<b>c</b> d<div>e</div>f<pre> x\n  y</pre>g": "a\nbc d\ne\nf\n\n x\n  y\n\ng",
    "<head><title>t</title><style>p{}</style></head><body>b<script>if (a</b) '</p>'</script>c": "bc",
    "<div hidden>no</div><p style='x:y; display : NONE'>no<p>yes &amp; &lt;ok&gt;&nbsp;!": "yes & <ok> !",
    "<details><summary>s</summary>closed</details><details open><summary>s</summary>open</details>": "s\ns\nopen",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<select><option>a<option>b</select><textarea> <b> &amp;</textarea>": "a\nb\n <b> &",
    "<i>a<div>b</i>c</div>": "a\nbc",
    "</p></div>z<br/><p>": "z",
    "x < y <3 <!-- no --><!doctype html><?php no ?>z": "x < y <3 z",
    "<a href='x": "",
    "<": "<",
    "<td>q</td>": "q",
    "<div>" * 3000 + "deep": "deep",
    "": "",
    "<html><head><title>T</title><p>Hello": "Hello",
    "<head><meta charset=x><style>a</style>\n<title>T</title>Hi<title>no</title> you</head><body>x": "Hi youx",
    "<head><template><p>no</p></template><noscript>no</noscript><link rel=x><a>yes</a>": "yes",
    "a<svg><title>no</title><defs><path d='x'/><text>no</text></defs><text>one</text><text>two</text></svg>b": "a\none\ntwo\nb",
    "<svg><style/><defs/><g><path/>x</g></svg> <math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>": "x y",
    "<svg><defs><p>out": "out",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i>too</i></b>no<br></div>z": "yestoo\nz",
    "<div style='display:none'>no<b style='visibility:visible'>no</b></div><i style='backface-visibility:hidden'>yes</i>": "yes",
    "<table style='visibility:hidden'>no<tr><td>no<td style='visibility:visible'>q<tr>no</table>": "q",
    "<ol><li>a<li style='visibility:hidden'>no<li>c</ol>": "1. a\n3. c",
}


@pytest.mark.parametrize("page", list(HTML))
def test_visible_text(page):
    assert visible_text(page) == HTML[page]


@pytest.mark.parametrize("tag", ["font", "b", "span", "div"])
def test_deep_pages_are_built_alike(tag):
    rest = "<p hidden>no</p><script>no</script><i style='display:none'>no</i><ol><li>x<li>y</ol><table><tr><td>a<td>bb<tr><td>c<td>d</table>z"
    for n in (1, 148, 200, 50_000):
        assert visible_text(f"<{tag}>" * n + rest) == visible_text(rest) == "1. x\n2. y\n\na | bb\nc | d\n\nz"
    assert visible_text(f"<div hidden>{f'<{tag}>' * 200}no<div>no</div>no") == ""
    nested = "<table><tr><td>" * 300 + "<ul><li>" * 300 + "<blockquote>" * 300 + "<tbody>" * 300 + "deep"
    assert visible_text(nested).split()[-1] == "deep"


def test_cells_span_many_rows():
    for down, last in ((3, "c"), (1500, "c"), (1502, "    c"), (65_534, "    c")):
        rows = visible_text(f"<table><tr><td rowspan={down}>a<td>b</tr>{'<tr><td>c</tr>' * 1501}</table>").split("\n")
        assert (rows[0], rows[1], rows[-1], len(rows)) == ("a | b", "    c", last, 1502)


def test_text_in_place_of_the_html(spark):
    pages = spark.createDataFrame([(1, "<b>x", "y", "z")], "page_id long, html string, html_source string, Html_Source_ string")
    done = extract(pages, to="html")
    assert done.columns == ["page_id", "html_source__", "html_source", "Html_Source_", "html"]
    assert tuple(done.first()) == (1, "<b>x", "y", "z", "x")


def test_visible_text_takes_anything():
    rng = random.Random(5)
    parts = ["<table>", "<td>", "<tr", ">", "</table>", "<li>", "<ul>", "</ul>", "<p>", "x y", "&amp", "<!--", "-->", '"', "'", "<a b=", "</", "<pre>", "\n", "<script>", "</script>", "<td rowspan=99999999 colspan=0>"]
    for _ in range(400):
        assert isinstance(visible_text("".join(rng.choices(parts, k=40))), str)


def test_all_words_of_clean_pages_are_kept(spark):
    import re

    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(40).collect():
        body = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->|<[^>]*>", " ", r.html or "")
        import html

        words = html.unescape(body).split()
        got = "".join(visible_text(r.html).split())
        assert sum(w in got for w in words) >= 0.95 * len(words)


def test_extract_of_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x", "c"), (3, "<p>" + "y " * 300_000, "d")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert (got[1], got[2], got[None]) == ("", "", "x") and len(got[3]) == 599_999
    assert extract(pages.limit(0)).count() == 0
    assert extract(pages, to="html").columns == ["page_id", "html_source", "text", "html"]


# WARC.

LARGE = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "x" * 2000
PAGES = [
    (1, "http://a/", LARGE), (5, "http://b/\r\nX: y", LARGE), (3, None, LARGE), (5, "http://b/", LARGE), (7, "u", "small"), (8, "u", "small"),
    (9, "u", None), (10, "u", ""), (11, "u", "y" * 1000), (None, "u", "y" * 1000), (12, "u", "\r\n\n" * 500), (13, "u", "z" * 3_000_000),
]


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS same", "'x' AS digest", "2 AS bytes")


def test_round_trip_of_edge_rows(spark):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages_of(spark)).collect())
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = max((p or 0 for p, _, h in PAGES if h == html), default=0)
        copy = len(data) >= 1000 and (page or 0) != same
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", same if copy else None))
    assert got == sorted(want)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_normalised_archives(spark, tmp_path):
    warc.write_monoliths(pages_of(spark).coalesce(1), str(tmp_path / "m"))
    index = warc.normalise(spark, str(tmp_path / "m"), str(tmp_path)).collect()
    assert len(index) == len(PAGES)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "m").glob("*.gz")))
    for r in index:
        data = (tmp_path / "archives" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(data).rstrip(b"\r\n") in whole
    for file in {r.file for r in index}:
        own = [r for r in index if r.file == file]
        assert gzip.decompress((tmp_path / "archives" / file).read_bytes()).count(b"WARC-Type") == len(own)


def test_cut_off_record(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 12\r\n\r\nA: b\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.gz").write_bytes(gzip.compress(record + record[:-10]))
    index = warc.normalise(spark, str(tmp_path / "m"), str(tmp_path))
    assert sorted(r.record_type for r in index.collect()) == ["damaged", "response"]
    assert [r.payload_bytes for r in warc.read_records(index, str(tmp_path)).collect()] == [4]


def test_record_stream_in_small_steps():
    blocks = [b"", b"a\r\n\r\nb", b"\r\n" * 9]
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    for step in (1, 3, 1000):
        records = warc.Records()
        assert [b for at in range(0, len(data), step) for _, b in records.feed(data[at : at + step])] == blocks
        assert records.rest() == b""


# Chat.

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|x|>"), (1, 2, "bob", None), (1, 2, None, "é"), (1, 2, "bob", None), (2, None, "ann", "q"),
    (3, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 0, "bob", "y"), (4, 255, "a", "p"), (4, 256, "b", "q"), (5, 0, "a", ""),
    (None, 0, "ann", "x"), (6, None, "cy", "ok"), (6, None, "cy", "ok"), (6, 1, "system", "s"), (6, None, None, None),
]


def turns_of(spark, rows=TURNS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'l' AS range", "2 AS turns", "3 AS width", "'d' AS digest")


def dialogue(turns, speaker, size):
    """Parts of the whole dialogue: number of turns, text, spans in the whole."""
    at, parts = 0, []
    for first in range(0, len(turns), size):
        text, mask = "", []
        for _, role, own in turns[first : first + size]:
            head = "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
            body = own.replace("<|", "< |") + "<|end|>"
            if role == speaker:
                mask.append((at + len(text + head), at + len(text + head + body)))
            text += head + body + "\n"
        parts.append((len(turns[first : first + size]), text, mask))
        at += len(text)
    return parts


def dialogues(rows, size):
    groups: dict = {}
    for i, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault((conv, i if conv is None else None), []).append((turn, role or "unknown", text or ""))
    want = []
    for (conv, _), turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        for speaker in {r for _, r, _ in turns} - {"system"}:
            want += [(str(conv), speaker, i, *part) for i, part in enumerate(dialogue(turns, speaker, size))]
    return sorted(want)


def shown(done):
    return sorted((str(r.conv_id), r.perspective, r.part, r.n_turns, r.text, [tuple(m) for m in r["mask"]]) for r in done.collect())


def test_perspectives_of_edge_rows(spark):
    assert shown(chat.perspectives(turns_of(spark))) == dialogues(TURNS, chat.PART)
    assert chat.perspectives(turns_of(spark, [])).count() == 0


def test_perspectives_of_a_long_dialogue(spark, monkeypatch):
    """Null and repeated turn numbers, many parts and blocks: one run of offsets, nothing lost."""
    rng = random.Random(3)
    monkeypatch.setattr(chat, "PART", 8)
    monkeypatch.setattr(chat, "BLOCK", 3)
    rows = [(7, rng.choice([None, 1, 2, i]), rng.choice(["a", "bob", "system", None]), rng.choice(["ok", "é <|", None, "x" * i])) for i in range(300)]
    rows += [(7, None, "a", "ok")] * 300 + [(8, i, rng.choice("ab"), "") for i in range(70)] + TURNS
    assert shown(chat.perspectives(turns_of(spark, rows))) == dialogues(rows, 8)


def test_perspectives_run_no_python(spark):
    plan = chat.listed(turns_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


# Vectors.


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'v' AS v", "1 AS score", "2 AS dim")


def scored(rows, k=20):
    kept = {}
    for id_, e in rows:
        if id_ is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept[id_, tuple(int(np.floor(64 * float(np.float32(x)))) for x in e)] = None
    out = []
    for q in sorted({i for i, _ in kept if i % 20 == 0}):
        own = [v for i, v in kept if i == q]
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in own for i, w in kept if i != q and len(v) == len(w))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("bucket", [7, 4096])
def test_top_k_of_odd_vectors(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(80)]  # ties
    rows += [(2000 + i, [0.0] * 8) for i in range(30)] + [(3000 + i, [1.0, float(i)]) for i in range(25)]
    rows += [(3000, [1.0, 0.0]), (4000, None), (4020, []), (4040, [1.0, None]), (4060, [float("nan"), 1.0]), (4080, [float("inf"), 1.0]), (None, [1.0, 2.0]), (5000, [3.0])]
    got = sorted(tuple(r) for r in topk.every_twentieth(vectors_of(spark, rows)).collect())
    assert got == sorted(scored(rows))


def test_top_k_prunes_by_coordinates(monkeypatch):
    # Close directions and equal lengths: thresholds are high.
    rng = np.random.default_rng(7)
    center = rng.normal(size=(5, 16))
    v = np.floor(64 * (center[rng.integers(0, 5, 400)] + rng.normal(size=(400, 16)) * 0.05))
    v = v[np.argsort(-(v * v).sum(axis=1), kind="stable")]
    ids = np.arange(400)
    q = topk.Queries(ids[::20] + 1000, v[::20])
    exact = np.sort(q.v @ v.T, axis=1)[:, ::-1][:, :10]
    q.bound = exact[:, -1].copy()
    best = topk.Best(q, 10)
    for at in range(0, 400, 100):
        topk.search_bucket(best, ids[at : at + 100], v[at : at + 100])
    assert (best.score == exact).all()


def test_top_k_of_an_empty_table(spark):
    assert topk.every_twentieth(vectors_of(spark, [])).count() == 0


# The pipeline and the registration.


def test_pipeline(spark):
    import corpus_pipeline
    from cases import contamination, jaccard_components

    from veilscan.llm import secrets

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    known = [(i, t) for i, t in docs.items() if t and any(map(str.isalpha, t))]
    first = [(i, docs[i]) for i, _, c in jaccard_components(known, 5, 80, 100) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = {i: secrets.masked(docs[i], "[secret]") for i, _, hit, _ in contamination(first, items) if not hit}
    done = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id: r.text for r in done.collect()} == want
    assert done.where("decoded <> text").count() == 0


def test_stages_of_edge_rows(spark):
    import corpus_pipeline

    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == documents(spark).columns
    assert {r.doc_id for r in docs.collect()} == {1, 6, None, 8, 9}
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


def test_the_rest_works_without_these(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    (tmp_path / "veilscan").mkdir()
    for part in (ROOT / "veilscan").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "veilscan" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op1_') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)

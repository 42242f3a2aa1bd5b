import random

from pyspark.sql import functions as F

from veilscan.operators import listing
from veilscan.params import FOLDER_MIME, ScanParams
from veilscan.sources import files

DOC = "application/vnd.google-apps.document"
SHEET = "application/vnd.google-apps.spreadsheet"


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "file_id string, mime_type string, content binary")
    return {r.file_id: r.text for r in files.extract_text(df).collect()}


def test_decoding(spark):
    korean = "주민등록 여권"
    cp949_only = "똠방각하 펲시"
    got = texts_of(spark, [
        ("utf8", "text/plain", bytearray(korean.encode())),
        ("bom", DOC, bytearray(b"\xef\xbb\xbfhi")),
        ("euckr", "text/plain", bytearray(korean.encode("euc-kr"))),
        ("cp949", "text/plain", bytearray(cp949_only.encode("cp949"))),
        ("latin", "text/plain", bytearray("é".encode("latin-1") + b"\xff!")),
        ("empty", "text/plain", bytearray(b"")),
        ("blank", "text/plain", bytearray("\n　 ".encode())),
        ("none", "text/plain", None),
        ("pdf", "application/pdf", bytearray(b"%PDF")),
        ("odd", "image/png", bytearray(b"text")),
    ])
    assert got == {
        "utf8": korean, "bom": "﻿hi", "euckr": korean, "cp949": cp949_only, "latin": "é\xff!",
        "empty": None, "blank": None, "none": None, "pdf": None, "odd": None,
    }


def test_decoding_is_that_of_the_codecs(spark):
    """Every pair of bytes, spelled syllables, random and cut bytes; no Python in the plan."""
    rng = random.Random(5)

    def plain(raw):
        for charset in ("utf-8", "euc-kr", "cp949"):
            try:
                return raw.decode(charset)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    raws = [bytes([a, b, 65]) for a in range(128, 256) for b in range(256)]
    spelled = ["\ub894\uac02".encode("euc-kr"), b"\xa4\xd4\xa4\xa1\xa4\xbf\xa4\xd4", b"\xa4\xd4", b"\xa4\xd4\xa4\xd4\xa4\xbf\xa4\xd4"]
    units = [*spelled, "\ud55c\uae00".encode("euc-kr"), "\ub620".encode("cp949"), "\ubdc1".encode("cp949"), b"a\n", b"\xe9", b"\xa4"]
    raws += [b"".join(rng.choices(units, [4, 4, 1, 1, 9, 9, 1, 9, 1, 1], k=rng.randrange(1, 6))) for _ in range(1500)]
    raws += [b"\xa4\xd4" + bytes(x for _ in range(3) for x in (0xA4, rng.randrange(0xA0, 256))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, bytearray(raw)) for i, raw in enumerate(raws)], "id int, content binary")
    done = rows.repartition(8).select("id", files.plain_text(F.col("content")).alias("text"))
    assert not any(k in done._jdf.queryExecution().executedPlan().toString() for k in ("Python", "Arrow"))
    got = {r.id: r.text for r in done.collect()}
    assert [(raws[i], got[i]) for i in got if got[i] != plain(raws[i])] == []


def test_csv(spark):
    rows = 'a, b ,,c\n\n"two\nlines","say ""hi"""\r\n  ,  \nlast'
    got = texts_of(spark, [("csv", SHEET, bytearray(rows.encode())), ("same", "text/csv", bytearray("가,나".encode("cp949")))])
    assert got == {"csv": 'a b c\n\ntwo\nlines say "hi"\n\nlast', "same": "가 나"}


def test_csv_reads_what_the_standard_reader_reads(spark):
    import csv
    import io
    import random

    def plain(text):
        try:
            return "\n".join(" ".join(filter(None, map(str.strip, row))) for row in csv.reader(io.StringIO(text)))
        except csv.Error:
            return ""

    rng = random.Random(8)
    parts = ["a", " ", ",", '"', '""', "\n", "\r\n", "\r", "é ", "\u3000", '"x, y"', '"q ""r"" ', ",,", '"'] + ["b"] * 3
    texts = ["", "\n", "a\n", "a\n\n", "a\n,", ",", '""', '"', '"a', '"a\n', 'a"b"', '"a"b"c,d', "a\rb", "a\r\n", "a\r"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", files.flatten_csv(F.col("t")).alias("x")).collect()}
    bad = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not bad, bad[:5]


def test_own_extractor(spark):
    df = spark.createDataFrame([("a", "application/pdf", bytearray(b"x@y.example"))],
                               "file_id string, mime_type string, content binary")
    mine = {**files.EXTRACTORS, "application/pdf": lambda c: F.upper(c.cast("string"))}
    assert files.extract_text(df, mine).first().text == "X@Y.EXAMPLE"


def test_scan_files_reports_errors_per_row(spark):
    df = spark.createDataFrame(
        [("ok", "text/plain", bytearray(b"m x@y.example")), ("gone", "text/plain", None),
         ("empty", "text/plain", bytearray(b" ")), ("clean", "text/plain", bytearray(b"hello"))],
        "file_id string, mime_type string, content binary",
    )
    got = {r.file_id: (r.error, r.total_chars, len(r.findings)) for r in files.scan_files(df).collect()}
    assert got == {"ok": (None, 13, 1), "gone": (files.DOWNLOAD_FAILED, 0, 0),
                   "empty": (files.NO_TEXT, 0, 0), "clean": (None, 5, 0)}


def test_local_folder(spark, tmp_path):
    for name, content in (("a.b.TXT", b"x@y.example"), ("plain", b"hi"), ("c.Pdf", b"%PDF"), ("blank.txt", b" \n")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "deep.txt").write_bytes(b"not seen")
    listed = {r.file_id: r for r in files.local_files(spark, str(tmp_path)).collect()}
    assert {k: (v.file_name, v.mime_type) for k, v in listed.items()} == {
        "local_a.b": ("a.b.TXT", "text/plain"), "local_plain": ("plain", "text/plain"),
        "local_c": ("c.Pdf", "application/pdf"), "local_blank": ("blank.txt", "text/plain"),
    }
    got = {r.file_id: (r.error, r.total_chars, len(r.findings))
           for r in files.scan_local_folder(spark, str(tmp_path)).collect()}
    assert got == {"local_a.b": (None, 11, 1), "local_plain": (None, 2, 0),
                   "local_c": (files.NO_TEXT, 0, 0), "local_blank": (None, 2, 0)}


ITEM = ("id string, name string, mimeType string, size string, modifiedTime string, trashed boolean,"
        " parents array<string>, owners array<struct<emailAddress:string>>")


def item(id_, name, parents, mime="text/plain", trashed=False, owners=None, size=None, time=None):
    return (id_, name, mime, size, time, trashed, parents, owners)


def test_tree(spark):
    chain = [item(f"d{i}", f"L{i}", [f"d{i - 1}" if i else "root"], FOLDER_MIME) for i in range(6)]
    items = spark.createDataFrame(
        [
            *chain,
            item("loop", "loop", ["d5", "loop2"], FOLDER_MIME),
            item("loop2", "loop2", ["loop"], FOLDER_MIME),
            item("bin", "bin", ["root"], FOLDER_MIME, trashed=True),
            item("deep", "deep.txt", ["d5"], owners=[("a@b.example",), ("c@d.example",)], size="12", time="t"),
            item("two", "two.txt", ["d0", "d1", "elsewhere"], owners=[(None,)]),
            item("inloop", "x.txt", ["loop2"], owners=[]),
            item("trashed", "t.txt", ["d0"], trashed=True),
            item("below", "b.txt", ["bin"]),
            item("image", "i.png", ["d0"], "image/png"),
            item("top", "top.txt", ["root"], trashed=None),
        ],
        ITEM,
    )
    rows = listing.list_files(items).collect()
    deep = "/My Drive/L0/L1/L2/L3/L4/L5"
    assert sorted((r.file_id, r.path, r.owner, r.size, r.modified_time) for r in rows) == sorted([
        ("deep", f"{deep}/deep.txt", "a@b.example", 12, "t"),
        ("two", "/My Drive/L0/two.txt", "Unknown", 0, ""),
        ("two", "/My Drive/L0/L1/two.txt", "Unknown", 0, ""),
        ("inloop", f"{deep}/loop/loop2/x.txt", "Shared Drive / External", 0, ""),
        ("top", "/My Drive/top.txt", "Shared Drive / External", 0, ""),
    ])
    below = listing.list_files(items, ScanParams(folder_id="d5"))
    assert sorted(r.path for r in below.collect()) == ["/L5/deep.txt", "/L5/loop/loop2/x.txt"]
    unknown = spark.createDataFrame([item("f", "f.txt", ["ghost"])], ITEM)
    assert [r.path for r in listing.list_files(unknown, ScanParams(folder_id="ghost")).collect()] == ["/ghost/f.txt"]


def test_users(spark):
    users = spark.createDataFrame(
        [("c@x", None, None), ("a@x", False, False), ("b@x", True, False), ("d@x", False, True)],
        "primaryEmail string, suspended boolean, archived boolean",
    )
    assert [r.email for r in listing.active_users(users).collect()] == ["a@x", "c@x"]


def test_first_user_wins(spark):
    def files_of(*rows):
        return spark.createDataFrame(rows, "file_id string, path string")

    both = listing.union_listings([files_of(("f", "/z"), ("f", "/y")), files_of(("f", "/a"), ("g", "/b"))])
    got = sorted((r.file_id, r.path, r.user_rank) for r in listing.first_listing_wins(both).collect())
    assert got == [("f", "/y", 0), ("g", "/b", 1)]


def test_shared_folder_follows_the_cluster_setting(spark, tmp_path, monkeypatch):
    from veilscan.sources import workspace

    class Conf:
        def get(self, key, default):
            return f"{tmp_path}/" if key == "spark.checkpoint.dir" else default

    monkeypatch.setattr(type(spark), "conf", property(lambda self: Conf()))
    assert workspace.shared_folder(spark).startswith(f"{tmp_path}/veilscan-")


def test_csv_is_cut_once(spark):
    """Cells are read by five passes, not by five for each place that uses them."""
    df = spark.createDataFrame([(b'a ,,"b ""c""",d\n,\n"two\nlines"',)], "content binary")
    done = df.select(files.csv_text(F.col("content")).alias("text"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count(r"\G(?:") == 5
    assert done.first().text == 'a b "c" d\n\ntwo\nlines'


def test_letters_and_csv_in_tasks_of_bounded_length(spark, tmp_path, monkeypatch):
    from veilscan.plans import queries
    from veilscan.sources import workspace

    monkeypatch.setattr(workspace, "TASK_ROWS", 10, raising=False)
    for key, columns in (("o_orderkey", "o_orderkey + 0 AS o_custkey"), ("c_custkey", "concat('C#', c_custkey) AS c_name")):
        name = "orders" if key == "o_orderkey" else "customer"
        spark.range(1, 201).coalesce(1).withColumnRenamed("id", key).selectExpr("*", columns).write.parquet(f"{tmp_path}/{name}.parquet")
    part = "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size"
    spark.range(200).coalesce(1).selectExpr(*part).write.parquet(f"{tmp_path}/part.parquet")
    for made in (queries.letters(spark, str(tmp_path)), queries.extract_csv(spark, str(tmp_path))):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200 and len(sizes) == 20 and max(sizes) <= 2 * 10

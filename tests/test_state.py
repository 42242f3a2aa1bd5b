import json
import random

import pytest
from pyspark.sql import functions as F

from veilscan.operators import resume
from veilscan.operators.scan import FINDING_TYPE, scan_rows
from veilscan.sources import cache
from veilscan.sources.state import ScanState
from veilscan.streaming.incremental import running_totals, scan_batch, scan_stream, text_stream

FINDINGS = f"array<{FINDING_TYPE}>"


def entry(n, time="t1", error=None):
    found = [
        {"entity_type": "NPI", "confidence": 0.85, "start": i, "end": i + 10, "masked_value": "1********3"}
        for i in range(n)
    ]
    return {"modified_time": time, "total_chars": 100 * n, "findings": found, "error": error}


def key(i):
    return f"id_{i:030d}-x"


def read_entries(spark, tmp_path, content, name="cache.json"):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    rows = cache.recover_entries(spark, str(path))
    return rows, sorted(
        (r.k, r.file_id, r.outcome, r.total_chars, None if r.findings is None else len(r.findings))
        for r in rows.collect()
    )


def plain_recovery(content):
    """Outcome per entry start, the slow way."""
    import re

    out = []
    for k, m in enumerate(re.finditer(r'"([a-zA-Z0-9_-]{25,})":\s*\{', content), start=1):
        window = content[m.start() :]
        depth, end = 0, None
        for place, c in enumerate(window):
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                end = place + 1
                break
        row = None
        if end is not None:
            try:
                row = json.loads("{" + window[:end] + "}").get(m.group(1))
            except ValueError:
                end = None
        if end is None:
            out.append((k, m.group(1), "skipped", None, None))
        elif not row:
            out.append((k, m.group(1), "empty", None, None))
        elif not isinstance(row.get("findings", []), list):
            out.append((k, m.group(1), "no_findings", row.get("total_chars"), None))
        else:
            out.append((k, m.group(1), "recovered", row.get("total_chars"), len(row.get("findings", []))))
    return out


def test_load_cache(spark, tmp_path):
    good = {key(1): entry(2), "short": entry(0, error="x"), key(3): {"modified_time": "t"}}
    (tmp_path / "a.json").write_text(json.dumps(good, ensure_ascii=False, indent=1))
    (tmp_path / "b.json").write_text('{"cut": {"modified_time": ')
    rows = {r.file_id: r for r in cache.load_cache(spark, str(tmp_path)).collect()}
    assert set(rows) == set(good)
    assert len(rows[key(1)].findings) == 2 and rows["short"].error == "x" and rows[key(3)].findings is None


def test_recovery_cases(spark, tmp_path):
    text = json.dumps({key(1): entry(2), key(2): {}, key(3): {**entry(1), "findings": None}})[:-1]
    text += f', "{key(4)}": {{"modified_time": "a", "error": "brace }} inside", "findings": []}}'
    text += f', "{key(5)}": {{"modified_time": "b"}}, "{key(1)}": ' + json.dumps(entry(5, "t2"))
    text += f', "{key(6)}": ' + json.dumps({"error": "y" * 60_000})
    text += f', "{key(7)}": {{"modified_time": "c", "findings": [{{"entity_type": "NPI"'
    rows, got = read_entries(spark, tmp_path, text)
    assert got == plain_recovery(text)
    counters = cache.recovery_counters(rows).first()
    assert (counters.recovered, counters.skipped, counters.findings) == (4, 3, 7)
    state = {r.file_id: r for r in cache.recovered_state(rows).collect()}
    assert state[key(1)].modified_time == "t2" and len(state[key(1)].findings) == 5
    assert set(state) == {key(1), key(3), key(5), key(6)} and state[key(3)].findings == []


def test_unclosed_entry_that_closes_behind_the_next_one(spark, tmp_path):
    inner = json.dumps(entry(1))
    text = f'{{"{key(1)}": {{"modified_time": "a", "{key(2)}": {inner}, "{key(3)}": {inner}}}, "{key(4)}": {inner}}}'
    _, got = read_entries(spark, tmp_path, text)
    assert got == plain_recovery(text)
    assert [g[2] for g in got] == ["recovered"] * 4


def test_recovery_agrees_with_plain_python_on_random_damage(spark, tmp_path):
    rng = random.Random(2)
    whole = json.dumps({key(i): entry(rng.randrange(4), error=rng.choice([None, "}{", "é한 \" {"])) for i in range(150)},
                       ensure_ascii=False)
    pieces, at = [], 0
    while at < len(whole):
        step = rng.randrange(50, 3000)
        pieces.append(whole[at : at + step])
        at += step + rng.randrange(0, 120)
    text = "".join(pieces)
    _, got = read_entries(spark, tmp_path, text)
    assert got == plain_recovery(text)
    assert {g[2] for g in got} >= {"recovered", "skipped"}


def test_long_entries_and_small_blocks(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(f'"{key(i)}": {json.dumps(entry(rng.choice([0, 1, 700])))}, ' for i in range(40))
    text = text[:-2] + rng.choice(["", "\n", "}"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        rows, got = read_entries(spark, tmp_path, text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == plain_recovery(text) and {g[2] for g in got} == {"recovered"}


def test_cut_entry_before_many_good_ones(spark, tmp_path):
    good = "".join(f', "{key(i)}": {json.dumps(entry(1))}' for i in range(1, 10_001))
    _, got = read_entries(spark, tmp_path, f'"{key(0)}": {{"modified_time": "t", "findings": [{{' + good)
    assert [g[2] for g in got] == ["skipped"] + ["recovered"] * 10_000


def results(spark, rows):
    schema = f"file_id string, modified_time string, total_chars int, findings {FINDINGS}, error string"
    return spark.createDataFrame(rows, schema)


def test_cache_split(spark):
    files = spark.createDataFrame(
        [("same", "t1", "/a"), ("changed", "t2", "/b"), ("new", "t1", "/c"), ("failed", "t1", "/d")],
        "file_id string, modified_time string, file_path string",
    )
    known = results(spark, [("same", "t1", 5, None, None), ("changed", "t1", 5, [], None),
                            ("failed", "t1", None, [], "boom"), ("gone", "t1", 1, [], None)])
    hits = {r.file_id: r for r in resume.cached_results(files, known).collect()}
    assert set(hits) == {"same", "failed"}
    assert hits["failed"].error == "boom" and hits["failed"].total_chars == 0
    assert hits["same"].findings == [] and hits["same"].file_path == "/a"
    assert {r.file_id for r in resume.files_to_scan(files, known).collect()} == {"changed", "new"}


def test_upsert_replaces_all_rows_of_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_id string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "file_id string, n int")
    assert sorted(map(tuple, resume.upsert(old, new).collect())) == [("a", 9), ("b", 3), ("c", 4)]
    # A file scanned again without findings loses its old ones.
    replaced = spark.createDataFrame([("b",)], "file_id string")
    kept = resume.replace_keys(old, new.limit(0), replaced, "file_id")
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("a", 2)]


def batch(spark, rows):
    return spark.createDataFrame(rows, "file_id string, modified_time string, text string")


def test_state_before_first_write_is_empty(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "none"))
    totals = running_totals(state).first()
    assert (totals.files_done, totals.total_findings, totals.last_activity) == (0, 0, None)


def test_batches_rescan_changes_only_and_replay_changes_nothing(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))
    first = batch(spark, [("a", "1", "mail a@b.example"), ("b", "1", "nothing"), ("c", "1", " ")])
    second = batch(spark, [("a", "2", "no more"), ("b", "1", "never read x@y.example"), ("d", "1", "c@d.example")])
    scan_batch(first, 0, state)
    scan_batch(second, 1, state)

    def snapshot():
        rows = state.results().select("file_id", "modified_time", F.size("findings"), "error")
        return sorted(map(tuple, rows.collect()))

    empty = "Text extraction returned empty content"
    want = [("a", "2", 0, None), ("b", "1", 0, None), ("c", "1", 0, empty), ("d", "1", 1, None)]
    assert snapshot() == want
    assert sorted(r.file_id for r in state.log().where("batch_id = 1").collect()) == ["a", "d"]
    scan_batch(second, 1, state)
    assert snapshot() == want
    assert [r.file_id for r in state.findings().collect()] == ["d"]
    compacted = state.compact(str(tmp_path / "compacted"))
    assert compacted.log().count() == 4
    scan_batch(batch(spark, [("b", "2", "q@r.example")]), 2, compacted)
    assert sorted(r.file_id for r in compacted.findings().collect()) == ["b", "d"]


def test_unknown_times_are_scanned(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))
    first = batch(spark, [("a", None, "a@b.example"), ("b", "", "c@d.example"), ("c", None, None), ("c", None, None)])
    scan_batch(first, 0, state)
    assert sorted(r.file_id for r in state.findings().collect()) == ["a", "b"]
    # Unknown stays unknown: nothing has changed, null or ''.
    scan_batch(batch(spark, [("a", "", "x"), ("b", None, "x"), ("d", None, "e@f.example")]), 1, state)
    assert [r.file_id for r in state.log().where("batch_id = 1").collect()] == ["d"]
    files = spark.createDataFrame([("a", None), ("x", None)], "file_id string, modified_time string")
    known = results(spark, [("a", None, 5, [], None)])
    assert [r.file_id for r in resume.cached_results(files, known).collect()] == ["a"]
    assert [r.file_id for r in resume.files_to_scan(files, known).collect()] == ["x"]


def test_streams_do_not_replace_each_other(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))
    scan_batch(batch(spark, [("a", "1", "a@b.example")]), 0, state, stream="one")
    scan_batch(batch(spark, [("a", "1", "not read"), ("b", "1", "c@d.example")]), 0, state, stream="two")
    assert sorted(r.file_id for r in state.findings().collect()) == ["a", "b"]
    # A later batch of any stream wins, whatever its number; a replay keeps its place.
    scan_batch(batch(spark, [("a", "2", "none")]), 0, state, stream="three")
    scan_batch(batch(spark, [("a", "1", "a@b.example")]), 0, state, stream="one")
    assert [r.file_id for r in state.findings().collect()] == ["b"]


def test_a_new_checkpoint_is_a_new_stream(spark, tmp_path):
    state, inbox = ScanState(spark, str(tmp_path / "state")), tmp_path / "inbox"
    schema = "file_id string, modified_time string, text string"
    for offsets, rows in (("old", [("a", "1", "a@b.example")]), ("new", [("b", "1", "c@d.example")]), ("new", [])):
        if rows:
            batch(spark, rows).coalesce(1).write.parquet(str(inbox / offsets))
        stream = text_stream(spark, str(inbox) + "/*", schema)
        scan_stream(stream, state, str(tmp_path / offsets)).awaitTermination()
        if offsets == "old":
            assert [r.file_id for r in state.findings().collect()] == ["a"]
    assert sorted(r.file_id for r in state.findings().collect()) == ["a", "b"]
    assert state.log().select("stream").distinct().count() == 2


def test_newest_version_within_a_batch(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))
    scan_batch(batch(spark, [("a", "1", "x@y.example"), ("a", "2", "none")]), 0, state)
    assert [tuple(r) for r in state.versions().collect()] == [("a", "2")]
    assert state.findings().count() == 0


def test_stream_restart_adds_only_new_files(spark, tmp_path):
    inbox, offsets = tmp_path / "inbox", str(tmp_path / "offsets")
    state = ScanState(spark, str(tmp_path / "state"))
    schema = "file_id string, modified_time string, text string"

    def deliver(name, rows):
        batch(spark, rows).coalesce(1).write.parquet(str(inbox / name))

    def run():
        stream = text_stream(spark, str(inbox) + "/*", schema, max_files=1)
        scan_stream(stream, state, offsets).awaitTermination()
        return state.log().groupBy("batch_id").count().count(), state.findings().count()

    deliver("one", [("a", "1", "a@b.example")])
    deliver("two", [("b", "1", "c@d.example e@f.example")])
    assert run() == (2, 3)
    assert run() == (2, 3)
    deliver("three", [("a", "2", "gone"), ("b", "1", "not read again")])
    assert run() == (3, 2)


def test_a_failed_write_leaves_the_old_batch(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))
    scan_batch(batch(spark, [("a", "1", "x@y.example"), ("b", "1", "none")]), 0, state)
    broken = batch(spark, [("a", "2", "none")]).withColumn("error", F.raise_error(F.lit("lost")).cast("string"))
    for batch_id in (0, 1):
        with pytest.raises(Exception, match="lost"):
            state.write_batch(broken, batch_id)
    assert sorted(tuple(r) for r in state.versions().collect()) == [("a", "1"), ("b", "1")]
    assert state.batches().count() == 1 and state.findings().count() == 1


def test_streams_that_write_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    state = ScanState(spark, str(tmp_path / "state"))

    def write(n):
        state.write_batch(batch(spark, [("a", str(n), "x"), (f"own{n}", "1", "x")]), n // 3, f"stream{n % 3}")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(9)))
    order = [(r.seq, r.stream, r.batch_id) for r in state.batches().orderBy("seq").collect()]
    assert len({o[0] for o in order}) == 9
    last = order[-1]
    versions = dict(tuple(r) for r in state.versions().collect())
    assert len(versions) == 10 and versions["a"] == str(3 * last[2] + int(last[1][-1]))
    # A replay of an early batch keeps its place; the file stays at the newest one's version.
    _, stream, batch_id = order[0]
    state.write_batch(batch(spark, [("a", "again", "x")]), batch_id, stream)
    assert dict(tuple(r) for r in state.versions().collect())["a"] == versions["a"]
    assert state.batches().count() == 9 and state.log().where(f"stream = '{stream}' AND batch_id = {batch_id}").count() == 1


def test_totals_are_added_up_batch_by_batch(spark, tmp_path):
    state = ScanState(spark, str(tmp_path / "state"))

    def recount():
        rows = state.results().collect()
        times = [r.last_scanned for r in rows]
        return (len(rows), sum(bool(r.error) for r in rows), sum(len(r.findings or ()) for r in rows), max(times, default=None))

    def check(kept):
        for _ in range(2):  # the second time from what was kept
            assert tuple(running_totals(state).first()) == recount()
        assert len(list((tmp_path / "state" / "totals").glob("t*.json"))) == kept

    def write(rows, batch_id, stream="main", day=1):
        results = batch(spark, rows).withColumn("text", F.nullif("text", F.lit("")))
        failed = results.withColumn("error", F.when(F.col("text").isNull(), "no text"))
        done = scan_rows(failed, "text").withColumn("last_scanned", F.lit(f"2020-01-0{day}").cast("timestamp"))
        state.write_batch(done, batch_id, stream)

    check(0)
    write([("a", "1", "x@y.example"), ("b", "1", "c@d.example e@f.example"), ("c", "1", "")], 0)
    check(1)
    write([("b", "2", "none"), ("d", "1", "q@r.example")], 1, day=5)
    check(2)
    write([("d", "2", ""), ("b", "3", "s@t.example")], 2, day=3)  # the last activity goes back
    check(3)
    write([("a", "9", "")], 0, "other", day=2)
    check(4)
    write([("b", "2", "u@v.example w@x.example"), ("e", "1", "y@z.example")], 1, day=5)  # a replay in between
    check(5)

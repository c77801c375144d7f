"""Streams with keyed state over several batches, and the kept state of folds."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.operators import fold, incremental, ordered
from siteloom.plans.shared import shared_path
from siteloom.sources import tables
from siteloom.streaming import live

STEP = "visit_id string, step_seq long, page_url string, action string, finished boolean, ts timestamp"


def _stream(spark, batches, schema):
    """One file a batch, in order."""
    path = shared_path(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return live.observation_stream(spark, path, schema, files=1)


def _told(spark, stream):
    out = []
    live.run_available_to(stream, shared_path(spark, "c"), lambda batch, n: out.append([tuple(x) for x in batch.collect()]), "append")
    return out


def _at(minute):
    return f"2024-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"


def _steps(spark, batches):
    typed = [[(v, n, f"p{n}", "go", end, _at(m)) for v, n, end, m in rows] for rows in batches]
    path = shared_path(spark, "in")
    for rows in typed:
        frame = spark.createDataFrame(rows, STEP.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(path)
    return live.observation_stream(spark, path, STEP, files=1)


def test_visits_end_whole_late_lost_and_repeated(spark):
    batches = [
        [("whole", 1, False, 0), ("lost", 1, False, 0), ("turned", 2, True, 1)],
        [("whole", 2, True, 1), ("whole", 1, False, 0), ("turned", 1, False, 0), ("lost", 2, False, 1), ("lost", 2, False, 1)],
        [("whole", 1, False, 0), ("clock", 1, False, 30)],  # a step of a visit that was told
        [("clock", 2, False, 90)],  # event time passes the lost visit
        [("lost", 3, False, 2), ("clock", 3, True, 100)],  # later than the watermark
    ]
    told = _told(spark, live.visit_traces(_steps(spark, batches), timeout_minutes=20, delay="10 minutes"))
    flat = [x for rows in told for x in rows]
    assert sorted((v, [s.step_seq for s in steps], n, done) for v, steps, n, done in flat) == [
        ("clock", [1, 2, 3], 3, True),
        ("lost", [1, 2], 2, False),
        ("turned", [1, 2], 2, True),
        ("whole", [1, 2], 2, True),
    ]
    assert {x[0] for x in told[1]} == {"whole", "turned"}


def test_visits_of_one_bucket_end_each_by_itself(spark):
    batches = [
        [("a", 1, False, 0), ("b", 1, False, 10), ("c", 2, True, 0)],
        [("d", 1, False, 40)],  # event time passes a and c, not b
        [("e", 1, False, 41)],
        [("b", 2, True, 29), ("b", 1, False, 10), ("d", 2, False, 41)],
        [("end", 1, True, 500)],
        [("end", 1, True, 501)],
    ]
    told = _told(spark, live.visit_traces(_steps(spark, batches), timeout_minutes=20, delay="15 minutes", buckets=1))
    flat = sorted((v, [s.step_seq for s in steps], n, done) for rows in told for v, steps, n, done in rows)
    assert flat == [("a", [1], 1, False), ("b", [1, 2], 2, True), ("c", [2], 1, False), ("d", [1, 2], 2, False), ("e", [1], 1, False), ("end", [1], 1, True)]


def _frontier(spark, batches, schema="url string, pos long", **given):
    out = shared_path(spark, "frontier")
    live.live_frontier(_stream(spark, batches, schema), F.lit("https://a.org"), out, shared_path(spark, "c"), **given)
    found = spark.read.parquet(out)
    return sorted((x.batch, x.clean) for x in found.collect())


def test_frontier_admits_once_and_keeps_the_limit_over_batches(spark):
    token = lambda i: f"https://a.org/u/{i:016d}x"
    batches = [
        [("https://a.org/x/", 2), ("http://www.a.org/x#y", 1), (token(1), 3), (token(2), 5), ("https://b.org/", 6), ("mailto:x", 7)],
        [("https://a.org/x", 8), (token(1), 9), (token(3), 12), (token(4), 11)],
        [("https://a.org/x", 13), (token(3), 14), (token(5), 15), ("https://a.org/y", 16)],
    ]
    assert _frontier(spark, batches) == [(0, "a.org/u/" + f"{1:016d}x"), (0, "a.org/u/" + f"{2:016d}x"), (0, "a.org/x"), (1, "a.org/u/" + f"{4:016d}x"), (2, "a.org/y")]


def test_frontier_counts_visits_before_and_meanwhile(spark):
    token = lambda i: f"https://a.org/u/{i:016d}x"
    clean = lambda i: token(i).removeprefix("https://")
    seen = spark.createDataFrame([(token(1),), (token(1) + "/",)], "url string")
    batches = [[(token(1), 1, False), (token(2), 2, False), (token(3), 3, False), (token(2), 4, True)], [(token(4), 5, False), (token(5), 6, False)]]
    got = _frontier(spark, batches, "url string, pos long, visited boolean", per_shape=4, visited=seen)
    assert got == [(0, clean(3)), (1, clean(4))]


def test_frontier_reduces_rows_before_its_state():
    rows = [{"shape": f"s{i % 2}", "clean": f"c{i % 20}", "url": f"u{i % 20}", "pos": 1000 - i, "visited": False} for i in range(1000)]
    rows += [{"shape": "s0", "clean": "c0", "url": "u0", "pos": None, "visited": True}] * 50
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=100)
    found = [x for batch in live._first_links(3)(iter(batches)) for x in batch.to_pylist()]
    assert sorted((x["shape"], x["clean"], x["pos"]) for x in found if not x["visited"]) == [
        ("s0", "c14", 6), ("s0", "c16", 4), ("s0", "c18", 2), ("s1", "c15", 5), ("s1", "c17", 3), ("s1", "c19", 1),
    ]
    assert [(x["clean"], x["pos"]) for x in found if x["visited"]] == [("c0", None)]


def test_slowdown_over_batches_and_repeated_deliveries(spark):
    schema = "crawl_id string, seq long, elapsed_seconds double"
    rows = [("c", i, 1.0 + (i * 7) % 5) for i in range(20)]
    told = _told(spark, live.slowdown_monitor(_stream(spark, [rows[:7], rows[5:12], rows[12:]], schema)))
    flat = [x for part in told for x in part]
    assert [x[1] for x in flat] == list(range(20))
    want = ordered.backoff_state(spark.createDataFrame(rows, schema)).first()
    assert flat[-1][3:] == (pytest.approx(want.wait), want.broken)
    off = _told(spark, live.slowdown_monitor(_stream(spark, [rows], schema), ceiling=None))[0]
    assert {x[3:] for x in off} == {(0.0, False)} and max(x[2] for x in off) == 5.0


def test_slowdown_forgets_idle_crawls(spark):
    path = shared_path(spark, "in")
    for rows in ([("c", 1, 1.0, _at(0))], [("d", 1, 1.0, _at(60))], [("d", 2, 1.0, _at(61)), ("c", 2, 9.0, _at(62))]):
        frame = spark.createDataFrame(rows, "crawl_id string, seq long, elapsed_seconds double, ts string")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = live.observation_stream(spark, path, "crawl_id string, seq long, elapsed_seconds double, ts timestamp", files=1)
    told = [x for part in _told(spark, live.slowdown_monitor(stream, idle_minutes=10)) for x in part]
    assert [x[2] for x in told if x[:2] == ("c", 2)] == [1.0]


def _page(url, status, seq):
    return ("s", "e", url, status, seq, "", "", seq, None)


def test_coverage_counts_what_a_batch_changed(spark):
    batches = [
        [_page("a", "Finished", 1), _page("b", "Pending", 2), _page("c", "Pending", 3)],
        [_page("a", "Failed", 4), _page("b", "Finished", 5), _page("b", "Pending", 6)],
        [_page("d", "Finished", 7)],
    ]
    out = shared_path(spark, "coverage")
    live.live_coverage(_stream(spark, batches, tables.PAGE_EVENT), out, shared_path(spark, "c"), buckets=4)
    got = [(x.finished, x.total, x.changed) for x in spark.read.parquet(out).orderBy("batch").collect()]
    assert got == [(1, 3, 3), (1, 3, 2), (2, 4, 1)]


def test_state_reads_new_events_and_touched_buckets_only(spark):
    kept, path = incremental.pages_fold(), shared_path(spark, "state")
    table = incremental.StateTable(spark, path, kept, buckets=8)
    rows = [_page(f"u{i}", ("Pending", "Finished", "Failed")[i % 3], i) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, tables.PAGE_EVENT)
    assert table.append(frame(rows), 0).filter("before is null").count() == 60
    late = [_page("u1", "Failed", 100), _page("u1", "Pending", 101), _page("new", "Pending", 102), _page("u2", "Finished", -1)]
    changes = {x.url: x for x in table.append(frame(late), 1).collect()}
    assert set(changes) == {"u1", "new", "u2"}
    assert changes["u1"].before.settled.status == "Finished" and changes["u1"].after.settled.status == "Failed"
    assert changes["new"].before is None
    want = {tuple(x) for x in fold.current_pages(frame(rows + late)).collect()}
    assert {tuple(x) for x in table.current().collect()} == want
    # Three keys lie in three buckets at most; no other was written again.
    fs, at = table._fs(f"{path}/rows/version=1")
    written = [x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")]
    assert 1 <= len(written) <= 3
    versions = table._versions(1)
    assert {f"bucket={b}" for b, v in versions.items() if v == 1} == set(written)
    # One key is read from its own bucket.
    one = table.current(url="u1")
    assert [x.status for x in one.collect()] == ["Failed"]
    assert len({f.rsplit("/", 2)[-2] for f in one.inputFiles()}) == 1
    assert table.current(url="none").count() == 0


def test_state_batches_run_again(spark):
    schema = "`from` string, `to` string, component string, action string, run_id string, ts timestamp, event_seq long"
    edge = lambda n, seq: [(f"p{i}", "q", "c", "GO", "" if i % 2 else f"r{seq}", None, seq + i) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = incremental.StateTable(spark, shared_path(spark, "state"), incremental.edges_fold(), buckets=4)
    with pytest.raises(ValueError):
        table.current()
    for batch, rows in enumerate((edge(3, 0), edge(5, 10), [], edge(2, 20))):
        first = sorted(map(str, table.append(frame(rows), batch).collect()))
        assert sorted(map(str, table.append(frame(rows), batch).collect())) == first
    with pytest.raises(ValueError):
        table.append(frame([]), 1)
    want = {tuple(x) for x in fold.current_edges(frame(edge(3, 0) + edge(5, 10) + edge(2, 20))).collect()}
    assert {tuple(x) for x in table.current().collect()} == want
    assert len(table._batches()) == 2

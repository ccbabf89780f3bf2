import json
import os
import time

import pytest
from data import DELAYED, INORDER, rows, table

from tidemark.operators.lateness import SlidingPolicy
from tidemark.operators.session_policies import SessionPolicy
from tidemark.plans.profiles import PROFILES
from tidemark.sources import readers
from tidemark.streaming import sinks
from tidemark.streaming.live import live_session_counts, live_sliding_counts, merge_sessions_early
from tidemark.streaming.stateful import live_count_windows, live_panes, live_running_average, live_session_panes


def folder(path, events):
    """One file per event; a stream takes them one by one, oldest first."""
    path.mkdir()
    for n, (t, key, value) in enumerate(events):
        file = path / f"record{n:02}.csv"
        file.write_text(f"{t},{key},{value}\n")
        os.utime(file, (1_000_000 + n, 1_000_000 + n))
    return str(path)


def stream_events(spark, path, files_per_trigger=1, arrival=None):
    return readers.stream_events(spark, path, files_per_trigger=files_per_trigger, arrival=arrival)


def run(df, name, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name).collect(), query


@pytest.mark.parametrize("which", ["inorder", "delayed"])
def test_live_counts_equal_the_replay(spark, tmp_path, which):
    events = {"inorder": INORDER, "delayed": DELAYED}[which]
    path = folder(tmp_path / "in", events)
    merge_sessions_early(spark)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")  # the count doesn't depend on what a query remembers
    dropped = sinks.DroppedLate()
    spark.streams.addListener(dropped)
    try:
        _live_equals_replay(spark, path, events, which, dropped)
    finally:
        spark.streams.removeListener(dropped)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def reported(spark, dropped, query):
    """Listeners are told a moment after a query ends."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(20):
        before = dropped.rows(query)
        time.sleep(0.3)
        if before == dropped.rows(query):
            return before


def _live_equals_replay(spark, path, events, which, dropped):
    # one event per file and batch, so the batch number is the arrival number
    df = table(spark, rows(events))
    replayed = PROFILES["spark"].sliding(df, "t", "pos", 10, 2, ["key"]).collect()
    got, query = run(live_sliding_counts(stream_events(spark, path), "10 milliseconds", "2 milliseconds"), f"s_{which}")
    assert {tuple(r) for r in got} == {(r.start, r.end, r.key, r["count"]) for r in replayed}
    assert reported(spark, dropped, query) == {"inorder": 0, "delayed": 37}[which]
    sessions, query = run(live_session_counts(stream_events(spark, path), "10 milliseconds", control_key="W"), f"g_{which}")
    assert {tuple(r) for r in sessions} == {
        "inorder": {(1, 36, "A", 11), (27, 40, "W", 0)},
        "delayed": {(13, 25, "A", 2), (23, 36, "A", 2), (27, 40, "W", 0)},
    }[which]
    assert reported(spark, dropped, query) == {"inorder": 0, "delayed": 7}[which]


def test_a_watched_folder_is_created(spark, tmp_path):
    later = tmp_path / "not" / "there"
    got, _ = run(stream_events(spark, str(later)), "nothing_yet")
    assert got == [] and later.is_dir()


def test_control_rows_move_progress_but_do_not_count(spark, tmp_path):
    path = folder(tmp_path / "in", INORDER)
    counts = live_sliding_counts(stream_events(spark, path), "10 milliseconds", "2 milliseconds", control_key="W")
    got, _ = run(counts, "no_control")
    assert (26, 36, "A", 1) in {tuple(r) for r in got} and all(r.key == "A" for r in got)


def test_live_panes(spark, tmp_path):
    path = folder(tmp_path / "in", DELAYED)
    got, _ = run(live_panes(stream_events(spark, path), SlidingPolicy(10, 2, -1, 4), early_every=2), "panes")
    reports = sorted((r.start_ms, r.key, r.pane_kind, r["count"]) for r in got if r.pane_kind != "late_row")
    import brute

    want = brute.panes(rows(DELAYED), 10, 2, -1, 4, 2)
    # no end of input on a stream: windows past the last progress are not closed
    assert reports == [p for p in want if p[0] + 9 <= 500 or p[2] == "early"]
    assert sorted(r.start_ms for r in got if r.pane_kind == "late_row") == [1, 1, 2, 2, 5, 14, 19]


def test_live_session_panes(spark, tmp_path):
    path = folder(tmp_path / "in", DELAYED)
    merged = PROFILES["flink"].session_policy(10)
    got, _ = run(live_session_panes(stream_events(spark, path), merged), "merged")
    assert {(r.start_ms, r.end_ms, r.key, r["count"]) for r in got if r.pane_kind == "on_time"} == {
        (13, 25, "A", 2), (14, 36, "A", 3), (27, 40, "W", 2)
    }
    assert sorted(r.start_ms for r in got if r.pane_kind == "late_row") == [1, 1, 2, 2, 5, 19]
    late = PROFILES["flink"].with_lateness(10).session_policy(10)
    got, _ = run(live_session_panes(stream_events(spark, path), late), "merged_late")
    assert [(r.pane_kind, r.start_ms, r.end_ms, r["count"]) for r in got if r.key == "A" and r.pane_kind != "late_row"] == [
        ("on_time", 13, 25, 2), ("late", 13, 36, 4), ("late", 5, 36, 5), ("late", 2, 36, 6), ("late", 1, 36, 7),
        ("late", 1, 36, 8),
    ]


def test_live_early_reports_with_lateness(spark, tmp_path):
    import brute

    path = folder(tmp_path / "in", DELAYED)
    policy = PROFILES["flink"].with_lateness(10).session_policy(10)
    got, _ = run(live_session_panes(stream_events(spark, path), policy, early_every=2), "early_late")
    reports = sorted((r.pane_kind, r.start_ms, r.end_ms - 10, r.key, r["count"]) for r in got if r.pane_kind != "late_row")
    want = brute.session_panes(rows(DELAYED), 10, True, -1, 9, 9, early=2, flush=False)
    assert reports == want and any(r[0] == "early" for r in want)


@pytest.mark.parametrize("frame", [1, 10_000])
def test_frames_of_a_batch_do_not_matter(spark, tmp_path, frame):
    """A backlog in one batch, out of order: the rows of a key are taken by arrival, over all Arrow frames."""
    backlog = [(27, "A", 1), (24, "A", 1), (21, "A", 1), (18, "A", 1)]
    path = folder(tmp_path / "in", [(40, "W", 0)])
    late = tmp_path / "late"
    late.mkdir()
    order = [0, 2, 1, 3]  # as the files are handed over
    for n, i in enumerate(order):
        file = late / f"r{n}.csv"
        file.write_text(f"{backlog[i][0]},A,1\n")
        os.utime(file, (2_000_000 + i, 2_000_000 + i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(frame))
    try:
        policy = SessionPolicy(3, accept=15, alive=15)
        first = stream_events(spark, path, arrival="arrival")
        rest = stream_events(spark, str(late), files_per_trigger=None, arrival="arrival")
        got, _ = run(live_session_panes(first.union(rest), policy, arrival="arrival"), f"frames_{frame}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not [r for r in got if r.key == "A" and r.pane_kind == "late_row"]


def test_live_panes_leave_out_early_starts(spark, tmp_path):
    path = folder(tmp_path / "in", INORDER)
    policy = PROFILES["kafka"].sliding_policy(10, 2)
    got, _ = run(live_panes(stream_events(spark, path), policy), "min_start")
    replayed = PROFILES["kafka"].sliding(table(spark, rows(INORDER)), "t", "pos", 10, 2, ["key"]).collect()
    on_time = {(r.start_ms, r.end_ms, r.key, r["count"]) for r in got if r.pane_kind == "on_time"}
    assert min(s for s, *_ in on_time) == 0
    assert on_time == {(r.start, r.end, r.key, r["count"]) for r in replayed if r.end <= 500}


@pytest.mark.parametrize("size, slide, lines, keyed", [(5, 2, 3, True), (6, 4, 50, True), (2, 3, 7, False)])
def test_live_count_windows(spark, tmp_path, size, slide, lines, keyed):
    """However the rows are cut to batches, the windows are those of the replay."""
    import brute
    from data import disordered

    from tidemark.sources.ordered import stream_ordered_events

    events = [(t, k, 1) for t, k in disordered(51, n=24)]
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("\n".join(f"{t},{k},{v}" for t, k, v in events))
    windows = live_count_windows(stream_ordered_events(spark, str(path), lines_per_batch=lines), size, slide, keyed, arrival="arrival")
    query = windows.writeStream.format("memory").queryName(f"count_{size}").outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.key, r.firing, r.min_ts, r.max_ts, r["count"]) for r in spark.table(f"count_{size}").collect())
    assert got == brute.count_windows(rows(events), size, slide, keyed) and len(got) >= 5


def test_a_look_reads_a_snapshot_and_the_tail(spark, tmp_path):
    log = sinks._ChangeLog(str(tmp_path), ["key"], 5)
    want = {}
    for batch in range(13):
        changed = [(s, s + 10, key, batch * 10 + s) for s in range(batch % 3, 6, 2) for key in ("A", None)]
        want |= {(s, key): n for s, _, key, n in changed}
        log.write(spark.createDataFrame(changed, "start_ms bigint, end_ms bigint, key string, count bigint"), batch)
    look = sinks.latest(spark, str(tmp_path))
    assert {(r.start_ms, r.key): r["count"] for r in look.collect()} == want
    read = {part for f in look.inputFiles() for part in f.split("/") if "=" in part}
    assert read == {"upto=9", "batch=10", "batch=11", "batch=12"}
    # a batch that runs again replaces what it wrote, its snapshot too
    log.write(spark.createDataFrame([(0, 10, "A", 777)], "start_ms bigint, end_ms bigint, key string, count bigint"), 9)
    assert {(r.start_ms, r.key): r["count"] for r in log.newest(spark).collect()}[0, "A"] in (777, want[0, "A"])
    # a folder that was not finished does not count
    (tmp_path / "batch=13").mkdir()
    assert {(r.start_ms, r.key) for r in sinks.latest(spark, str(tmp_path)).collect()} == set(want)
    with pytest.raises(ValueError):
        sinks.latest(spark, str(tmp_path / "nothing"))


def test_running_average(spark, tmp_path):
    path = folder(tmp_path / "in", INORDER)
    got, _ = run(live_running_average(stream_events(spark, path), "value"), "averages")
    a = [v for _, k, v in INORDER if k == "A"]
    assert [r.average for r in got if r.key == "A"] == pytest.approx([sum(a[: i + 1]) / (i + 1) for i in range(len(a))])


def test_sinks(spark, tmp_path):
    path = folder(tmp_path / "in", INORDER)
    log = []
    listener = sinks.ProgressLog(log.append)
    spark.streams.addListener(listener)
    try:
        counts = live_session_counts(stream_events(spark, path), "10 milliseconds", control_key="W", keep_empty=False)
        sinks.to_text(counts, str(tmp_path / "text"), str(tmp_path / "c1"), sinks.UNTIL_DONE).start().awaitTermination()
        assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["(1,36,A,11)"]
        changes = live_sliding_counts(stream_events(spark, path, files_per_trigger=None), "10 milliseconds", "2 milliseconds")
        sinks.to_changelog(changes, str(tmp_path / "log"), str(tmp_path / "c2"), sinks.UNTIL_DONE).start().awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    assert any(json.loads(line).get("numInputRows") for line in log)
    latest = {(r.start_ms, r.key): r["count"] for r in sinks.latest(spark, str(tmp_path / "log")).collect()}
    assert latest[(-4, "A")] == 5 and latest[(500, "W")] == 1

    panes = live_panes(stream_events(spark, folder(tmp_path / "late", DELAYED)), SlidingPolicy(10, 2, -1, -1))
    out, late = str(tmp_path / "results"), str(tmp_path / "late_rows")
    sinks.to_results_and_late(panes, out, late, str(tmp_path / "c3"), sinks.UNTIL_DONE).start().awaitTermination()
    assert sorted(r.start_ms for r in spark.read.parquet(late).collect()) == [1, 1, 2, 2, 5, 14, 19]
    assert spark.read.parquet(out).filter("pane_kind = 'on_time' AND start_ms = 6").first()["count"] == 2

    panes = live_panes(stream_events(spark, str(tmp_path / "late")), SlidingPolicy(10, 2, -1, -1))
    lines = str(tmp_path / "late_lines")
    sinks.to_results_and_late(panes, str(tmp_path / "r2"), lines, str(tmp_path / "c4"), sinks.UNTIL_DONE, late_as_text=True).start().awaitTermination()
    got = sorted(r.value for r in spark.read.text(lines).collect())
    assert got == [f"(1970-01-01 00:00:00.{t:02},1970-01-01 00:00:00.{t:02},1)" for t in (1, 1, 2, 2, 5, 14, 19)]

    batch = spark.createDataFrame([(1, 36, "A", 11)], "start bigint, end bigint, key string, count bigint")
    sinks.write_text(batch, str(tmp_path / "batch"))
    assert [r.value for r in spark.read.text(str(tmp_path / "batch")).collect()] == ["(1,36,A,11)"]
    assert sinks.result_name("session", "delayed", early=True) == "session-early-for-delayed-keyed.txt"


def test_console(spark, tmp_path, capfd):
    path = folder(tmp_path / "in", INORDER)
    counts = live_session_counts(stream_events(spark, path, files_per_trigger=None), "10 milliseconds", control_key="W")
    sinks.to_console(counts, trigger=sinks.UNTIL_DONE).start().awaitTermination()

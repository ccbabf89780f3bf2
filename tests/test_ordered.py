"""The stream of lines in order, its end of input, and progress that only control rows move."""

import os

import brute
import pytest
from data import DELAYED, rows, table

from tidemark.operators.lateness import SlidingPolicy
from tidemark.plans.profiles import PROFILES
from tidemark.sources import ordered
from tidemark.sources.ordered import END_MS, _Reader, stream_ordered_events, stream_ordered_lines
from tidemark.streaming.stateful import live_panes, live_session_panes


def write(folder, name, lines, at, end="\n"):
    file = folder / name
    file.write_text("\n".join(lines) + end)
    os.utime(file, (at, at))


def lines_of(events):
    return [f"{t},{key},{value}" for t, key, value in events]


@pytest.fixture
def delayed(tmp_path):
    """The delayed order in three files."""
    folder = tmp_path / "in"
    folder.mkdir()
    lines = lines_of(DELAYED)
    write(folder, "b.csv", lines[:5], 1_000)
    write(folder, "a.csv", lines[5:6], 2_000, end="")
    write(folder, "c.csv", lines[6:], 3_000)
    return folder


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name).collect()


def go_on(df, folder):
    """Run from the checkpoint in a folder until nothing is left; the sizes of the batches."""
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(processingTime="0 seconds").start(f"{folder}/out")
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def test_splits_hold_every_line_once(tmp_path):
    lines = ["", "a", "longer line", "é" * 7, "x\r", "", "last"]
    write(tmp_path, "one", lines, 10)
    write(tmp_path, "two", lines, 20, end="")
    write(tmp_path, "_hidden", ["no"], 30)
    want = []
    for base in (0, len(("\n".join(lines) + "\n").encode())):
        for line in lines:
            want.append((line.removesuffix("\r"), base))
            base += len(line.encode()) + 1
    for split in (1, 2, 3, 7, 1000):
        for block in (1, 4, 1 << 20):
            ordered._READ_BYTES = block
            reader = _Reader({"path": str(tmp_path), "split_bytes": str(split)})
            parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
            got = [pair for p in parts for b in reader.read(p) for pair in zip(b["value"].to_pylist(), b["arrival"].to_pylist())]
            assert got == want
    ordered._READ_BYTES = 1 << 20


@pytest.mark.parametrize("lines", [1, 3, 100])
def test_batches_end_after_any_line(delayed, lines):
    (delayed / "_SUCCESS").touch()
    reader = _Reader({"path": str(delayed), "lines_per_batch": str(lines), "end_marker": "_SUCCESS"})
    at, got, sizes = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != at:
        batch = [p for part in reader.partitions(at, end) for b in reader.read(part) for p in zip(b["arrival"].to_pylist(), b["value"].to_pylist())]
        sizes.append(len(batch))
        got += batch
        at = end
    assert [v for _, v in got] == [*lines_of(DELAYED), f"{END_MS},W"]
    assert [a for a, _ in got] == sorted({a for a, _ in got})
    assert max(sizes) <= lines and sizes[-1] == 1


def test_no_folder_yet(tmp_path):
    reader = _Reader({"path": str(tmp_path / "later")})
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_a_restart_loses_and_repeats_nothing(spark, delayed, tmp_path):
    def stream():
        return stream_ordered_lines(spark, str(delayed), lines_per_batch=4)

    assert sum(go_on(stream(), tmp_path)) == 14
    write(delayed, "d.csv", ["600,A,1", "601,A,1", "602,A,1", "603,A,1", "604,A,1"], 4_000)
    assert sum(go_on(stream(), tmp_path)) == 5
    assert go_on(stream(), tmp_path) == []
    got = [(r.arrival, r.value) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("arrival").collect()]
    assert [v for _, v in got] == [*lines_of(DELAYED), "600,A,1", "601,A,1", "602,A,1", "603,A,1", "604,A,1"]
    assert len({a for a, _ in got}) == 19


def test_live_follows_records_and_the_end_closes_all(spark, delayed, tmp_path):
    """One line a batch: live equals the per-record rules, and after the end of input nothing is open."""
    (delayed / "_SUCCESS").touch()
    events = stream_ordered_events(spark, str(delayed), lines_per_batch=1, end_marker="_SUCCESS")
    # control rows of the input count in this profile, the row at the end is in no window that closes
    panes = live_panes(events, SlidingPolicy(10, 2, -1, -1))
    sizes = go_on(panes, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sizes == [1] * 15
    on_time = {(r.start_ms, r.key): r["count"] for r in got if r.pane_kind == "on_time"}
    replayed = PROFILES["flink"].sliding(table(spark, rows(DELAYED)), "t", "pos", 10, 2, ["key"]).collect()
    assert on_time == {(r.start, r.key): r["count"] for r in replayed}
    assert go_on(panes, tmp_path) == []  # the end comes once
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)


def test_available_now_leaves_no_window_open(spark, delayed):
    (delayed / "_SUCCESS").touch()
    events = stream_ordered_events(spark, str(delayed), end_marker="_SUCCESS")
    query = live_session_panes(events, PROFILES["flink"].session_policy(10), arrival="arrival").writeStream.format("memory").queryName(
        "ordered_now").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.start_ms, r.key): r["count"] for r in spark.table("ordered_now").collect() if r.pane_kind == "on_time"}
    # one batch: nothing is late
    assert got == {(1, "A"): 11, (27, "W"): 2, (500, "W"): 1}


def test_progress_by_control_rows_only(spark, delayed, tmp_path):
    """Sessions and windows follow control rows live as in the replay."""
    events = stream_ordered_events(spark, str(delayed), lines_per_batch=1)
    control = {"is_data": lambda k: k != "W", "moves": lambda k: k == "W"}
    policy = PROFILES["storm"].with_lateness(10).session_policy(10)
    got = run(live_session_panes(events, policy, arrival="arrival", control_key="W"), "punctuated")
    reports = sorted((r.pane_kind, r.start_ms, r.end_ms - 10, r.key, r["count"]) for r in got if r.pane_kind != "late_row")
    want = brute.session_panes(rows(DELAYED), 10, False, 0, 11, 10, flush=False, **control)
    assert reports == want and {k for _, _, _, k, _ in reports} == {"A"}
    _, dropped = brute.sessions(rows(DELAYED), 10, False, 0, 11, 10, False, **control)
    assert sorted(r.start_ms for r in got if r.pane_kind == "late_row") == sorted(DELAYED[n][0] for n in dropped)

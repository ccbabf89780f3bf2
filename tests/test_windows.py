from collections import Counter

import brute
import pytest
from data import DELAYED, INORDER, collected, disordered, rows, table
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lateness, progress
from tidemark.operators.count_windows import count_windows, each_row_a_window
from tidemark.operators.islands import range_min_ahead, sessions
from tidemark.operators.lateness import SlidingPolicy
from tidemark.operators.running import Running, running
from tidemark.operators.windows import Agg, native_session, native_sliding, sliding, sliding_right_closed, tumbling
from tidemark.plans.profiles import PROFILES, profile_diff
from tidemark.plans.tables import replay
from tidemark.session import in_ranges

WINDOW = ("start", "key", "count")


def test_sliding_equals_spark_windows(spark):
    df = table(spark, disordered(1)).withColumn("at", F.timestamp_millis("t"))
    for size, slide in ((10, 2), (10, 3), (7, 7), (4, 10)):
        mine = collected(sliding(df, "t", size, slide, ["key"]), "start", "end", "key", "count")
        if slide <= size:
            theirs = native_sliding(df, "at", f"{size} milliseconds", f"{slide} milliseconds", ["key"])
            assert mine == collected(theirs, "start_ms", "end_ms", "key", "count")
    assert collected(tumbling(df, "t", 7, ["key"]), *WINDOW) == collected(sliding(df, "t", 7, 7, ["key"]), *WINDOW)


def test_window_aggregates(spark):
    df = table(spark, disordered(2))
    aggs = {"n": Agg("count"), "total": Agg("sum", F.col("t")), "low": Agg("min", F.col("t")),
            "mean": Agg("avg", F.col("t")), "a": Agg("count", when=F.col("key") == "A")}
    got = collected(sliding(df, "t", 10, 5, [], aggs), "start", "n", "total", "low", "mean", "a")
    want = []
    for start in range(-10, max(t for t, _ in disordered(2)) + 1, 5):
        inside = [(t, k) for t, k in disordered(2) if start <= t < start + 10]
        if inside:
            ts = [t for t, _ in inside]
            want.append((start, len(ts), sum(ts), min(ts), sum(ts) / len(ts), sum(k == "A" for _, k in inside)))
    assert got == want


def test_right_closed_membership(spark):
    df = table(spark, [(10, "A"), (11, "A"), (12, "A")])
    # (0,10] and (2,12] hold 10; 12 is still in (2,12]
    got = dict((s, n) for s, _, n in collected(sliding_right_closed(df, "t", 10, 2, ["key"]), *WINDOW))
    assert got == {0: 1, 2: 3, 4: 3, 6: 3, 8: 3, 10: 2}


def test_sessions_in_blocks(spark):
    events = disordered(3, n=200)
    df = table(spark, events).withColumn("at", F.timestamp_millis("t"))
    native = collected(native_session(df, "at", "10 milliseconds", ["key"]), "start_ms", "end_ms", "key", "count")
    for block in (None, 16, 50):
        assert collected(sessions(df, "t", 10, ["key"], block=block), "start", "end", "key", "count") == native
    touching = table(spark, [(1, "A"), (11, "A"), (20, "A")])
    assert collected(sessions(touching, "t", 10, ["key"]), "start", "end") == [(1, 30)]
    assert collected(sessions(touching, "t", 10, ["key"], inclusive=False), "start", "end") == [(1, 11), (11, 30)]
    assert collected(sessions(touching, "t", 10, []), "start", "end", "count") == [(1, 30, 3)]


def test_count_windows(spark):
    def spans(events, keys):
        got = count_windows(table(spark, rows(events)), "t", "pos", 5, 2, keys).orderBy("firing").collect()
        return [(r.min_ts, r.max_ts, r["count"]) for r in got if not keys or r.key == "A"]

    assert spans(INORDER, ["key"]) == [(1, 1, 2), (1, 2, 4), (1, 13, 5), (2, 15, 5), (13, 23, 5)]
    assert spans(DELAYED, ["key"]) == [(13, 15, 2), (13, 26, 4), (1, 26, 5), (1, 23, 5), (1, 14, 5)]
    assert spans(INORDER, []) == [(1, 1, 2), (1, 2, 4), (1, 13, 5), (2, 15, 5), (13, 23, 5), (15, 27, 5), (23, 500, 5)]
    assert spans(DELAYED, []) == [(13, 15, 2), (13, 27, 4), (1, 27, 5), (1, 27, 5), (1, 30, 5), (1, 30, 5), (1, 500, 5)]
    events = disordered(4)
    for size, slide in ((5, 2), (1, 1), (2, 5), (3, 3)):
        for limit in (10**6, 3):
            got = count_windows(table(spark, events), "t", "pos", size, slide, ["key"], max_group_rows=limit)
            assert collected(got, "key", "firing", "min_ts", "max_ts", "count") == brute.count_windows(
                events, size, slide, True
            )
    assert each_row_a_window(table(spark, events), "t", "pos").count() == len(events)


def test_running_in_chunks_equals_window_function(spark):
    # one key holds most rows; values may be missing
    df = table(spark, disordered(5, n=300, keys="AAAAAAAAB")).withColumn(
        "v", F.when(F.col("t") % 3 > 0, F.col("t"))
    ).withColumn("key", F.when(F.col("pos") % 50 > 0, F.col("key")))
    aggs = {"n": Running("count"), "s": Running("sum", "v"), "s0": Running("sum", "v", False),
            "m": Running("max", "v", False), "l": Running("min", "v"), "c": Running("count", "v", False)}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        for keys in (["key"], []):
            split = running(df, keys, "pos", aggs, max_group_rows=10)
            plain = df.withColumns({n: a.over(Window.partitionBy(*keys).orderBy("pos")) for n, a in aggs.items()})
            assert {tuple(r) for r in split.collect()} == {tuple(r) for r in plain.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_progress(spark):
    events = disordered(6)
    df = table(spark, events)
    for limit in (10**6, 10):
        got = progress.watermark_per_record(df, "t", "pos", max_group_rows=limit).orderBy("pos").collect()
        best, want = None, []
        for t, _ in events:
            want.append(best)
            best = t if best is None else max(best, t)
        assert [r.wm_before for r in got] == want
    steps = progress.watermark_punctuated(df, "t", "pos", F.col("key") == "W").orderBy("pos").collect()
    best, want = None, []
    for t, key in events:
        want.append(best)
        if key == "W":
            best = t if best is None else max(best, t)
    assert [r.wm_before for r in steps] == want
    text = df.withColumn("raw", F.when(F.col("pos") % 3 == 0, "x").otherwise(F.col("t").cast("string")))
    filled = progress.timestamp_or_progress(text, "raw", "pos").orderBy("pos").collect()
    best, want = None, []
    for n, (t, _) in enumerate(events):
        parsed = None if n % 3 == 0 else t
        want.append(best if parsed is None else parsed)
        best = max([x for x in (best, parsed) if x is not None], default=None)
    assert [r.event_time for r in filled] == want


def test_first_reached(spark):
    observed = spark.createDataFrame([(5, 3), (5, 1), (9000, 7), (20000, 9)], "x bigint, pos bigint")
    probes = spark.createDataFrame([(-4,), (5,), (6,), (9000,), (9001,), (20001,)], "x bigint")
    got = progress.first_reached(observed, probes, "x", "pos", "at")
    assert {r.x: r["at"] for r in got.collect()} == {-4: 1, 5: 1, 6: 7, 9000: 7, 9001: 9, 20001: None}


def test_range_min_ahead(spark):
    points = [(t, (t * 7) % 31) for t in (1, 2, 5, 8, 9, 14, 30)]
    df = spark.createDataFrame(points, "t bigint, v bigint")
    for reach in (1, 3, 10):
        got = range_min_ahead(df, df.select("t"), [], "t", {"v": "m"}, reach)
        want = {t: min([v for u, v in points if t < u <= t + reach], default=None) for t, _ in points}
        assert {r.t: r.m for r in got.collect()} == want


def _sliding(df, name, pos="pos"):
    return {(r.start, r.key): r["count"] for r in PROFILES[name].sliding(df, "t", pos, 10, 2, ["key"]).collect()}


def test_sliding_profiles_on_the_small_orders(spark):
    for events in (INORDER, DELAYED):
        df = table(spark, rows(events))
        flink, _ = brute.sliding(rows(events), 10, 2, -1)
        beam, _ = brute.sliding(rows(events), 10, 2, 0)
        kafka, _ = brute.sliding(rows(events), 10, 2, 0, min_start=0)
        assert _sliding(df, "flink") == flink
        assert _sliding(df, "beam") == {k: n for k, n in beam.items() if k[1] != "W"}
        assert _sliding(df, "kafka") == kafka
        # one row per batch, and no end of input
        assert _sliding(df, "spark") == {k: n for k, n in beam.items() if k[0] + 10 <= 500}
    flink, dropped = brute.sliding(rows(DELAYED), 10, 2, -1)
    assert flink[(18, "A")] == 1 and len(dropped) == 38
    counts = lateness.window_counts(df, "t", "pos", PROFILES["flink"].sliding_policy(10, 2), ["key"])
    total = counts.agg(F.sum("dropped"), F.sum(F.col("on_time") + F.col("late"))).first()
    assert tuple(total) == (38, 70 - 38)


def test_late_rows_of_the_delayed_order(spark):
    late = PROFILES["flink"].late(table(spark, rows(DELAYED)), "t", "pos", 10, 2).orderBy("pos").collect()
    assert [r.t for r in late] == [1, 2, 5, 2, 1, 14, 19]


def test_early_panes_of_the_inorder_order(spark):
    policy = PROFILES["flink"].sliding_policy(10, 2)
    got = lateness.panes(table(spark, rows(INORDER)), "t", "pos", policy, ["key"], 2).filter("key = 'A'")
    panes = {}
    for r in got.collect():
        panes.setdefault(r.start, []).append((r.pane_kind, r["count"]))
    assert sorted(panes[0]) == [("early", 2), ("early", 4), ("on_time", 5)]
    assert sorted(panes[-6]) == [("early", 2), ("early", 4), ("on_time", 4)]
    assert panes[26] == [("on_time", 1)]


def test_panes_against_row_by_row(spark):
    events = disordered(7)
    df = table(spark, events)
    for fire, accept, every in ((-1, -1, 2), (-1, 6, 3), (0, 9, None), (0, 40, 2)):
        policy = SlidingPolicy(10, 2, fire, accept)
        got = collected(lateness.panes(df, "t", "pos", policy, ["key"], every), "start", "key", "pane_kind", "count")
        assert got == brute.panes(events, 10, 2, fire, accept, every)


def test_many_windows_per_row(spark):
    events = disordered(8)
    policy = SlidingPolicy(40, 2, -1, -1)
    got = lateness.final_counts(table(spark, events), "t", "pos", policy, ["key"])
    want, _ = brute.sliding(events, 40, 2, -1)
    assert {(r.start, r.key): r["count"] for r in got.collect()} == want


def test_long_counts_become_rows(spark, monkeypatch):
    monkeypatch.setattr(lateness, "CHUNK", 4)
    df = spark.createDataFrame([(1, 2, 23, 2), (2, 2, 1, 2)], "g int, _first bigint, _last bigint, _step bigint")
    got = lateness._ranges_to_rows(df, ["g"], "count")
    assert collected(got, "g", "count") == [(1, c) for c in range(2, 24, 2)]


def test_unlimited_lateness_makes_arrival_order_irrelevant(spark):
    events = disordered(9)
    policy = SlidingPolicy(10, 2, 0, 10**6)
    a = lateness.final_counts(table(spark, events), "t", "pos", policy, ["key"])
    b = lateness.final_counts(table(spark, sorted(events)), "t", "pos", policy, ["key"])
    assert collected(a, *WINDOW) == collected(b, *WINDOW) == collected(
        sliding(table(spark, events), "t", 10, 2, ["key"]), *WINDOW
    )


def test_profile_diff(spark):
    df = table(spark, rows(INORDER))
    diff = profile_diff(
        PROFILES["flink"].sliding(df, "t", "pos", 10, 2, ["key"]),
        PROFILES["beam"].sliding(df, "t", "pos", 10, 2, ["key"]), ["key"],
    ).filter("key = 'A'").collect()
    assert [(r.start, r.left_count, r.right_count) for r in diff] == [(-8, 1, 2)]


@pytest.mark.parametrize("name", ["flink", "kafka", "storm"])
def test_shuffled_branches_give_the_same(spark, monkeypatch, name):
    """Nothing is small: bounds go to blocks and lists are not broadcast."""
    replayed = replay(spark, "/root/testdata/sf0.001")

    def result():
        return Counter(tuple(r) for r in PROFILES[name].sliding(replayed, "t", "pos", 60, 15, ["key"], "signup").collect())

    want = result()
    monkeypatch.setattr(lateness, "BROADCAST_ROWS", 0)
    assert result() == want and want


def test_blocks_follow_the_count(spark):
    """Bounds far apart share blocks, and one at the end of time doesn't put the others into one."""
    bounds = [i * 1_000_003 for i in range(400)] + [253_402_300_799_000_000]
    position = {b: (i * 37) % 401 for i, b in enumerate(bounds)}
    observed = spark.createDataFrame([(b, p) for b, p in position.items() if p % 3], "bound bigint, pos bigint")
    probes = spark.createDataFrame([(b + d,) for b in bounds for d in (0, 5)], "bound bigint")
    found = progress.first_reached(observed, probes, "bound", "pos", "at")
    want = {b + d: min((p for c, p in position.items() if p % 3 and c >= b + d), default=None) for b in bounds for d in (0, 5)}
    assert {r.bound: r["at"] for r in found.collect()} == want
    sizes = [r["count"] for r in in_ranges(probes, ["bound"], "part", 4).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_a_hot_key_at_fine_ticks_is_cut(spark):
    """One key at microseconds, with one row far away: no block has more than its share of points."""
    from tidemark.operators.islands import _in_blocks

    times = [i * 7 for i in range(2_000)] + [253_402_300_799_000_000]
    points = spark.createDataFrame([(t, "A") for t in times], "t bigint, key string")
    sizes = [r["count"] for r in _in_blocks(points, "t", ["key"], 250, None).groupBy("_block").count().collect()]
    assert max(sizes) <= 400 and sum(sizes) == len(times)
    one, many = (collected(sessions(points, "t", 600_000_000, ["key"], block=b), "start", "end", "count") for b in (None, 250))
    assert one == many and len(one) == 2
    ahead = [collected(range_min_ahead(points.withColumn("v", -F.col("t")), points, ["key"], "t", {"v": "m"}, 600_000_000, small), "t", "m")
             for small in (True, False)]
    assert ahead[0] == ahead[1]

import os

import pytest
from data import DELAYED, collected
from pyspark.sql import functions as F

from tidemark.functions.text import bound_or_default, format_average, format_row, gmt_text
from tidemark.functions.ticks import arrival_position, floor_div, floor_to, position_parts
from tidemark.operators.lateness import SlidingPolicy, final_counts
from tidemark.operators.routing import is_control, observed, split, without_control
from tidemark.operators.session_policies import SessionPolicy
from tidemark.sources.parsing import parse_lines
from tidemark.sources.readers import read_events, topic_options, with_flush_row

LINES = ["13,A,22", "13,A", "13", "x,A,1", "# note", "* note", "ts,key,value", ""]
ERROR = "error"
# what each policy makes of each line: (ts_ms, key, value), nothing, or an error
EXPECTED = {
    "spark": [(13, "A", 22.0), (13, "A", None), None, (None, "A", 1.0), None, None, (None, "key", None), None],
    "flink": [(13, "A", 22.0), (13, "A", "filled"), (13, "DUMMY", "filled"), ERROR, ERROR, None, ERROR, ERROR],
    "beam": [(13, "A", 22.0), ERROR, ERROR, ERROR, None, ERROR, ERROR, None],
    "kafka": [(13, "A", 22.0), (13, "A", None), None, None, None, None, None, None],
    "storm": [(13, "A", 22.0), (13, "A", 0.0), (13, "", 0.0), None, None, None, None, None],
}


@pytest.mark.parametrize("policy", list(EXPECTED))
def test_parse_policies(spark, policy):
    fine = [(line, want) for line, want in zip(LINES, EXPECTED[policy]) if want != ERROR]
    df = spark.createDataFrame([(n, line) for n, (line, _) in enumerate(fine)], "n int, value string")
    got = {r.n: r for r in parse_lines(df, policy, keep=["n"]).collect()}
    for n, (line, want) in enumerate(fine):
        if want is None:
            assert n not in got, line
        elif want[2] == "filled":
            assert (got[n].ts_ms, got[n].key) == want[:2] and round(got[n].value, 2) == got[n].value
        else:
            assert (got[n].ts_ms, got[n].key, got[n].value) == want
    bad = [line for line, want in zip(LINES, EXPECTED[policy]) if want == ERROR]
    if bad:
        one_row = spark.createDataFrame([(bad[0],)], "value string")
        with pytest.raises(Exception, match="bad timestamp|too few fields"):
            parse_lines(one_row, policy).collect()


def test_missing_values_differ_by_policy(spark):
    df = spark.createDataFrame([("7,A",), (" 8 , B , 9 ",)], "value string")
    assert [r.value_text for r in parse_lines(df, "kafka").orderBy("ts_ms").collect()] == ["", "9"]
    assert parse_lines(df, "kafka").orderBy("ts_ms").collect()[1].key == "B"


def test_read_events_in_arrival_order(spark, tmp_path):
    for n, (t, key, value) in enumerate(DELAYED):
        path = tmp_path / f"part{(n * 5) % 14}.csv"
        path.write_text(f"{t},{key},{value}\n")
        os.utime(path, (1_000_000 + n, 1_000_000 + n))
    got = read_events(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.ts_ms, r.key) for r in got] == [(t, k) for t, k, _ in DELAYED]
    assert [r.pos for r in got] == list(range(1, 15))
    one = tmp_path / "all.txt"
    one.write_text("\n".join(f"{t},{k},{v}" for t, k, v in DELAYED))
    events = read_events(spark, str(one), "storm")
    flushed = with_flush_row(events, SlidingPolicy(1000, 100)).orderBy("pos").collect()
    assert [r.ts_ms for r in flushed] == [t for t, _, _ in DELAYED] + [1500]
    assert flushed[-1].key == "W" and flushed[-1].pos == 15


def test_a_flush_row_closes_all_windows(spark):
    """Its time is past what the policy needs, whatever the size."""
    events = spark.createDataFrame([(0, "A", 1), (3_600_000, "A", 2), (3_599_999, "A", 3)], "ts_ms bigint, key string, pos bigint")
    events = events.withColumn("event_time", F.timestamp_millis("ts_ms"))
    for policy in (SlidingPolicy(3_600_000, 600_000, -1, 60_000), SlidingPolicy(10, 20)):
        flushed = with_flush_row(events, policy)
        closed = final_counts(flushed, "ts_ms", "pos", policy, ["key"], flush=False).filter("key = 'A'")
        full = final_counts(flushed, "ts_ms", "pos", policy, ["key"]).filter("key = 'A'")
        assert {tuple(r) for r in closed.collect()} == {tuple(r) for r in full.collect()}
    assert with_flush_row(events, SessionPolicy(5_000, alive=700)).agg(F.max("ts_ms")).first()[0] == 3_605_700


def test_random_fill_does_not_follow_the_splits(spark):
    lines = spark.createDataFrame([(i, f"{i},A") for i in range(2000)], "place bigint, value string")
    fill = lambda df: {r.place: r.value for r in parse_lines(df, "flink", keep=["place"]).collect()}
    one, many = fill(lines.coalesce(1)), fill(lines.repartition(7))
    assert one == many and 19.5 < sum(one.values()) / 2000 < 20.5 and len(set(one.values())) > 500
    assert 4 < (sum((v - 20) ** 2 for v in one.values()) / 2000) ** 0.5 < 6


def test_topic_options():
    assert topic_options("host:1", "in")["startingOffsets"] == "earliest"


def test_routing(spark):
    df = spark.createDataFrame([("A",), ("W",), ("w",), (None,)], "key string")
    control, data = split(df, is_control("key", "W"), F.lit(True))
    assert [r.key for r in control.collect()] == ["W"] and data.count() == 3
    assert without_control(df, "key", "W", ignore_case=True).count() == 2
    watched, observation = observed(df, "seen", rows=F.count(F.lit(1)), controls=F.count_if(F.col("key") == "W"))
    watched.collect()
    assert observation.get == {"rows": 4, "controls": 1}


def test_text_forms(spark):
    df = spark.createDataFrame([(1,), (13,), (500,), (86_400_000,), (-1,)], "ms bigint")
    assert [r[0] for r in df.select(gmt_text(F.col("ms"))).collect()] == [
        "1970-01-01 00:00:00.01", "1970-01-01 00:00:00.13", "1970-01-01 00:00:00.500", "1970-01-02 00:00:00.00",
        "1969-12-31 23:59:59.999",
    ]
    row = spark.createDataFrame([(1, 36, "A", 11, None)], "s bigint, e bigint, k string, c bigint, n bigint")
    text = row.select(format_row(F.col("s"), F.col("e"), F.col("k"), F.col("c")).alias("t"),
                      bound_or_default(F.col("n")).alias("d"), format_average(F.lit(3.5)).alias("a")).first()
    assert tuple(text) == ("(1,36,A,11)", -1, "Average so far is 3.500000")


def test_ticks(spark):
    df = spark.createDataFrame([(v,) for v in (-11, -10, -1, 0, 9, 10)], "v bigint")
    got = df.select("v", floor_to(F.col("v"), 10).alias("to"), floor_div(F.col("v"), 10).alias("by")).collect()
    assert all(r.to == r.v // 10 * 10 and r.by == r.v // 10 for r in got)
    pairs = [(5, 3), (5, 10**18), (6, 0), (10**17, 9 * 10**18), (2**63 - 1, 2**63 - 1), (1_700_000_000 * 10**9, 0)]
    positions = spark.createDataFrame(pairs, "a bigint, i bigint").withColumn(
        "p", arrival_position(F.col("a"), F.col("i"))
    )
    assert [(r.a, r.i) for r in positions.orderBy("p").collect()] == sorted(pairs)
    arrival, tie = position_parts(F.col("p"))
    assert collected(positions.select(arrival.alias("a"), tie.alias("i")), "a", "i") == sorted(pairs)

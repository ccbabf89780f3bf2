"""Aggregates and window functions of one's own, against plain loops over whole windows."""

import math
import random
import sys
from collections import defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import user_functions
from tidemark.operators.count_windows import count_windows
from tidemark.operators.islands import sessions
from tidemark.operators.user_functions import WindowFunction, count_function, session_function, sliding_function
from tidemark.operators.windows import Composed, sliding

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import a test

ROWS_SEEN = 40


class Spread(WindowFunction):
    """Largest less smallest value, the latest value by ``pos``, and how many values were missing."""

    inputs = ["value", "pos"]
    state = "lo double, hi double, at bigint, latest double, missing bigint"
    result = "struct<spread: double, latest: double, missing: bigint, key: string>"

    def make(self):
        return None, None, None, None, 0

    def add(self, state, rows):
        assert rows.num_rows <= ROWS_SEEN  # a batch's share of a slice, not a window
        for value, pos in zip(rows["value"].to_pylist(), rows["pos"].to_pylist()):
            state = self.merge(state, (value, value, pos, value, int(value is None)))
        return state

    def merge(self, left, right):
        pick = lambda f, i: f([x[i] for x in (left, right) if x[i] is not None], default=None)
        latest = max((x for x in (left, right) if x[2] is not None), key=lambda x: x[2], default=left)
        return pick(min, 0), pick(max, 1), latest[2], latest[3], left[4] + right[4]

    def finish(self, state, window):
        lo, hi, _, latest, missing = state
        return {"spread": None if lo is None else hi - lo, "latest": latest, "missing": missing, "key": window.get("key")}


class CountByKey(WindowFunction):
    """A whole pane's counts in one result."""

    inputs = ["key"]
    state = "counts map<string, bigint>"
    result = "string"

    def make(self):
        return ({},)

    def add(self, state, rows):
        counts = dict(state[0])
        for key in rows["key"].to_pylist():
            counts[str(key)] = counts.get(str(key), 0) + 1
        return (counts,)

    def merge(self, left, right):
        left, right = dict(left[0]), dict(right[0])
        return ({k: left.get(k, 0) + right.get(k, 0) for k in left | right},)

    def finish(self, state, window):
        counts = dict(state[0])
        return f"{window['start']}:" + ",".join(f"{k}={counts[k]}" for k in sorted(counts))


def made(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(300)]), rng.choice(["A", "A", "A", "B", None]), rng.choice([None, 1.5, 2.0, rng.random()]), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "t bigint, key string, value double, pos bigint").repartition(7)


def plain(rows):
    values = [r[2] for r in rows if r[2] is not None]
    latest = max(rows, key=lambda r: r[3])[2]
    return (max(values) - min(values) if values else None, latest, len(rows) - len(values))


@pytest.fixture(params=[3])
def few_states(request, monkeypatch, spark):
    monkeypatch.setattr(user_functions, "_MOST_STATES", request.param)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_SEEN))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sliding_windows(spark, few_states):
    rows, windows = made(), defaultdict(list)
    for r in rows:
        for start in range((r[0] // 20) * 20 - 40, r[0] + 1, 20) if r[0] is not None else ():
            windows[start, r[1]].append(r)
    got = sliding_function(frame(spark, rows), "t", 60, 20, ["key"], Spread()).collect()
    assert {(r.start, r.key): (r.result.spread, r.result.latest, r.result.missing) for r in got} == {k: plain(w) for k, w in windows.items()}
    assert all(r.result.key == r.key and r.end == r.start + 60 for r in got)


def test_windows_without_keys(spark, few_states):
    rows, windows = made(), defaultdict(lambda: defaultdict(int))
    for r in rows:
        if r[0] is not None:
            windows[r[0] // 50 * 50][str(r[1])] += 1
    got = sliding_function(frame(spark, rows), "t", 50, 50, [], CountByKey(), "text").collect()
    assert sorted(r.text for r in got) == sorted(f"{s}:" + ",".join(f"{k}={n}" for k, n in sorted(c.items())) for s, c in windows.items())


@pytest.mark.parametrize("block", [None, 16])
def test_sessions(spark, few_states, block):
    rows, found = made(120), {}
    for key in {r[1] for r in rows}:
        group: list = []
        for r in sorted((r for r in rows if r[1] == key and r[0] is not None), key=lambda r: r[0]) + [(math.inf,)]:
            if group and r[0] - group[-1][0] > 3:
                found[group[0][0], group[-1][0] + 3, key] = plain(group)
                group = []
            group.append(r)
    got = session_function(frame(spark, rows), "t", 3, ["key"], Spread(), block=block).collect()
    assert {(r.start, r.end, r.key): (r.result.spread, r.result.latest, r.result.missing) for r in got} == found
    assert len(found) > 30


def test_count_windows(spark, few_states):
    rows, found, by_key = made(), {}, defaultdict(list)
    for r in rows:
        by_key[r[1]].append(r)
        if len(by_key[r[1]]) % 4 == 0:
            found[r[1], len(by_key[r[1]])] = plain(by_key[r[1]][-10:])
    got = count_function(frame(spark, rows), "pos", 10, 4, ["key"], Spread(), max_group_rows=50).collect()
    assert {(r.key, r.firing): (r.result.spread, r.result.latest, r.result.missing) for r in got} == found


def test_no_rows(spark):
    empty = frame(spark, made()).filter("false")
    assert sliding_function(empty, "t", 60, 20, ["key"], Spread()).collect() == []
    assert session_function(empty, "t", 3, ["key"], Spread()).collect() == []
    assert count_function(empty, "pos", 10, 4, ["key"], Spread()).collect() == []


def test_composed_aggregates_in_all_windows(spark):
    """A variance in Spark expressions, without Python."""
    of = F.col("value")
    states = {"n": (F.count(of), F.sum), "s": (F.sum(of), F.sum), "q": (F.sum(of * of), F.sum)}
    variance = Composed(states, lambda s: s["q"] / s["n"] - (s["s"] / s["n"]) ** 2)
    rows = [(t, key, value + 1, pos) for t, key, value, pos in made() if t is not None and value is not None]
    df = frame(spark, rows)

    def expected(group):
        mean = sum(r[2] for r in group) / len(group)
        return pytest.approx(sum((r[2] - mean) ** 2 for r in group) / len(group), abs=1e-9)

    for r in sliding(df, "t", 60, 20, ["key"], {"v": variance}).collect():
        assert r.v == expected([x for x in rows if x[1] == r.key and r.start <= x[0] < r.end])
    for r in sessions(df, "t", 2, ["key"], {"v": variance}).collect():
        assert r.v == expected([x for x in rows if x[1] == r.key and r.start <= x[0] < r.end - 1])
    for r in count_windows(df, "t", "pos", 10, 4, ["key"], aggs={"v": variance}).collect():
        group = sorted((x for x in rows if x[1] == r.key), key=lambda x: x[3])
        assert r.v == expected(group[max(0, r.firing - 10) : r.firing])

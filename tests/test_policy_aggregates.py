"""Aggregates other than the count under late-data policies."""

import math

import pytest
from data import disordered, table
from pyspark.sql import functions as F

from tidemark.operators.lateness import SlidingPolicy, final_counts, pane_aggregates, panes
from tidemark.operators.session_policies import SessionPolicy, dropped_rows, policy_sessions
from tidemark.operators.windows import Agg, Composed



def aggregates():
    return {"n": Agg("count"), "total": Agg("sum", F.col("pos")), "latest": Agg("max", F.col("pos")), "mean": Agg("avg", F.col("pos"))}


def plain_panes(events, size, slide, fire, accept, early):
    """Every report with the arrival numbers of the rows taken so far."""
    wm, state, out = -math.inf, {}, []

    def advance(to):
        for (start, key), s in state.items():
            if not s["fired"] and to >= start + size + fire:
                s["fired"] = True
                if s["rows"]:
                    out.append((start, key, "on_time", tuple(s["rows"])))

    for n, (t, key) in enumerate(events):
        start = t // slide * slide
        while start + size > t:
            if wm < start + size + accept:
                s = state.setdefault((start, key), {"rows": [], "fired": wm >= start + size + fire})
                s["rows"].append(n)
                if s["fired"]:
                    out.append((start, key, "late", tuple(s["rows"])))
                elif len(s["rows"]) % early == 0:
                    out.append((start, key, "early", tuple(s["rows"])))
            start -= slide
        wm = max(wm, t)
        advance(wm)
    advance(math.inf)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_panes_show_what_a_window_had_taken(spark, limit):
    events = disordered(41, n=90)
    policy = SlidingPolicy(20, 5, -1, 9)
    got = pane_aggregates(table(spark, events), "t", "pos", policy, ["key"], aggregates(), early_every=3, max_group_rows=limit).collect()
    want = sorted((s, k, kind, len(r), sum(r), max(r), sum(r) / len(r)) for s, k, kind, r in plain_panes(events, 20, 5, -1, 9, 3))
    assert sorted((r.start, r.key, r.pane_kind, r.n, r.total, r.latest, r["mean"]) for r in got) == want
    counted = panes(table(spark, events), "t", "pos", policy, ["key"], early_every=3).collect()
    assert sorted((r.start, r.key, r.pane_kind, r["count"]) for r in counted) == sorted(w[:4] for w in want)


def test_only_states_that_can_run(spark):
    spread = Composed({"all": (F.collect_set("pos"), lambda c: F.flatten(F.collect_list(c)))}, lambda s: F.size(s["all"]))
    df = table(spark, disordered(42, n=40))
    policy = SlidingPolicy(20, 5, -1, 9)
    with pytest.raises(ValueError):
        pane_aggregates(df, "t", "pos", policy, ["key"], {"x": spread})
    # a final result can have any state
    got = final_counts(df, "t", "pos", policy, ["key"], aggs={"x": spread, "n": Agg("count")}).collect()
    assert got and all(r.x == r.n for r in got)


@pytest.mark.parametrize("policy", [SessionPolicy(10, True, -1, -1, -1), SessionPolicy(10, False, 0, 11, 10), SessionPolicy(10, pre_merge=True)])
def test_sessions_and_whole_late_rows(spark, policy):
    df = table(spark, disordered(43, n=110)).withColumn("count", F.col("pos") * 2).withColumn("first", F.lit("x"))
    aggs = {"count": Agg("count"), "total": Agg("sum", F.col("count"))}
    found = policy_sessions(df, "t", "pos", policy, ["key"], aggs=aggs).collect()
    counted = policy_sessions(df, "t", "pos", policy, ["key"]).collect()
    assert sorted((r.start, r.end, r.key, r["count"]) for r in found) == sorted((r.start, r.end, r.key, r["count"]) for r in counted)
    dropped = dropped_rows(df, "t", "pos", policy, ["key"], whole=True)
    assert dropped.columns == df.columns
    rows = dropped.collect()
    assert all(r["count"] == 2 * r.pos and r["first"] == "x" for r in rows)
    # every row is in a session or out of all
    assert sum(r.total for r in found) + sum(r["count"] for r in rows) == sum(2 * n for n in range(110))
    assert sum(r["count"] for r in found) + len(rows) == 110 and rows

import brute
import pytest
from data import DELAYED, INORDER, disordered, rows, table
from pyspark.sql import functions as F

from tidemark.operators import session_policies
from tidemark.operators.session_panes import early_panes, session_panes
from tidemark.operators.session_policies import SessionPolicy, policy_sessions
from tidemark.plans.profiles import PROFILES
from tidemark.session import expected_bytes, written

GOLDEN = {
    ("spark", 0): {(1, 36, "A"): 11, (27, 40, "W"): 0},
    ("spark", 1): {(13, 25, "A"): 2, (23, 36, "A"): 2, (27, 40, "W"): 0},
    ("flink", 0): {(1, 36, "A"): 11, (27, 40, "W"): 2, (500, 510, "W"): 1},
    ("flink", 1): {(13, 25, "A"): 2, (14, 36, "A"): 3, (27, 40, "W"): 2, (500, 510, "W"): 1},
    ("beam", 0): {(1, 36, "A"): 11},
    ("beam", 1): {(13, 25, "A"): 2, (23, 36, "A"): 2},
    ("kafka", 0): {(1, 26, "A"): 11, (27, 30, "W"): 2, (500, 500, "W"): 1},
    ("kafka", 1): {(13, 15, "A"): 2, (14, 26, "A"): 3, (27, 30, "W"): 2, (500, 500, "W"): 1},
    ("storm", 0): {(1, 36, "A"): 11},
    ("storm", 1): {(1, 36, "A"): 8},
}
DROPPED = {"spark": [1, 2, 5, 2, 1, 14, 19], "flink": [1, 2, 5, 2, 1, 19], "beam": [1, 2, 5, 2, 1, 14, 19],
           "kafka": [1, 2, 5, 2, 1, 19], "storm": [1, 2, 19]}


def profile(name):
    return PROFILES[name].with_lateness(10) if name == "storm" else PROFILES[name]


@pytest.mark.parametrize("name", list(PROFILES))
def test_profiles_on_the_small_orders(spark, name):
    for which, events in enumerate((INORDER, DELAYED)):
        df = table(spark, rows(events))
        got = profile(name).sessions(df, "t", "pos", 10, ["key"]).collect()
        assert {(r.start, r.end, r.key): r["count"] for r in got} == GOLDEN[(name, which)]
    drops = profile(name).session_drops(df, "t", "pos", 10, ["key"]).orderBy("pos").collect()
    assert [r.t for r in drops] == DROPPED[name]


POLICIES = {
    "merged": SessionPolicy(10, True, -1, -1, -1),
    "merged_late": SessionPolicy(10, True, -1, 6, 6),
    "own": SessionPolicy(10, False, 0, 0, 0, True),
    "grace": SessionPolicy(10, True, 0, 4, 5),
    "control": SessionPolicy(10, False, 0, 11, 10),
}


def check(spark, events, name, **options):
    policy, control = POLICIES[name], name == "control"
    where = dict(data=F.col("key") != "W", moves=F.col("key") == "W") if control else {}
    model = dict(is_data=lambda k: k != "W", moves=lambda k: k == "W") if control else {}
    want, _ = brute.sessions(events, policy.gap, policy.inclusive, policy.fire, policy.alive, policy.accept,
                             policy.pre_merge, **model)
    got = {}
    result = policy_sessions(table(spark, events), "t", "pos", policy, ["key"], end_is_last=True, **where, **options)
    for r in result.collect():
        got.setdefault((r.start, r.end, r.key), []).append(r["count"])
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("name", list(POLICIES))
def test_policies_against_row_by_row(spark, name):
    check(spark, disordered(11, n=150), name, block=24, max_group_rows=20)


def test_policies_without_a_key(spark):
    events = [(t, "all") for t, _ in disordered(12, n=100, steps=(0, 1, 2, 4, 12, 30))]
    want, _ = brute.sessions(events, 10, True, -1, -1, -1, False)
    got = policy_sessions(table(spark, events), "t", "pos", POLICIES["merged"], [], end_is_last=True).collect()
    assert {(r.start, r.end, "all"): [r["count"]] for r in got} == want


def test_long_runs_of_late_rows(spark, monkeypatch):
    """A backlog that comes newest first is accepted row by row; one that comes oldest first is not."""
    monkeypatch.setattr(session_policies, "_PLAIN_ROUNDS", 1)
    newest_first = [(300, "A"), (301, "B")] + [(t, "A") for t in range(296, 180, -4)]
    oldest_first = [(700, "A"), (701, "B")] + [(t, "A") for t in range(580, 696, 4)]
    mixed = [(1000, "A"), (1001, "B")] + [(t, "A") for t in (960, 985, 975, 994, 985, 976, 970, 964, 958, 958)]
    check(spark, newest_first + oldest_first + mixed, "merged", block=40)


def test_session_reports(spark):
    df = table(spark, rows(DELAYED))
    panes = session_panes(
        df, "t", "pos", profile("storm").session_policy(10), ["key"],
        moves=F.col("key") == "W", data=F.col("key") != "W", repeat=True, flush=False,
    ).collect()
    got = sorted((r.pane_kind, r.start, r.end, r["count"]) for r in panes)
    assert got == sorted([
        ("on_time", 13, 25, 2), ("late", 13, 36, 4), ("late", 5, 36, 5), ("late", 2, 36, 6), ("late", 1, 36, 7),
        ("late", 1, 36, 8), ("repeat", 1, 36, 8),
    ])
    late = session_panes(df, "t", "pos", PROFILES["flink"].with_lateness(10).session_policy(10), ["key"]).filter(
        "key = 'A'"
    ).collect()
    got = sorted((r.pane_kind, r.start, r.end, r["count"]) for r in late)
    # 23 bridges the fired [13,25) and [26,36); 5, 2, 1 and 14 join that later
    assert got == sorted([
        ("on_time", 13, 25, 2), ("late", 13, 36, 4), ("late", 5, 36, 5), ("late", 2, 36, 6), ("late", 1, 36, 7),
        ("late", 1, 36, 8),
    ])


def test_early_session_panes(spark):
    df = table(spark, rows(INORDER)).filter("key = 'A'")
    policy = PROFILES["flink"].session_policy(10)
    got = sorted((r.pane_kind, r.start, r.end, r["count"]) for r in early_panes(df, "t", "pos", policy, ["key"], 2).collect())
    assert got == sorted([("early", 1, 11, 2), ("early", 1, 12, 4), ("early", 1, 23, 6), ("early", 1, 25, 8),
                          ("early", 1, 33, 10), ("on_time", 1, 36, 11)])
    again = early_panes(df, "t", "pos", policy, ["key"], 2, reset_on_extend=True).collect()
    # only the second 1 and the second 2 leave the bounds as they were
    assert sorted((r.pane_kind, r["count"]) for r in again) == [("early", 2), ("early", 4), ("on_time", 11)]
    with pytest.raises(ValueError):
        early_panes(df, "t", "pos", SessionPolicy(10, accept=5), ["key"], 2)


@pytest.mark.parametrize("seed", [21, 22])
def test_session_reports_against_row_by_row(spark, seed):
    events = disordered(seed, n=150)
    df = table(spark, events)

    def got(panes):
        return sorted((r.pane_kind, r.start, r.end - 10, r.key, r["count"]) for r in panes.collect())

    late = POLICIES["merged_late"]
    assert got(session_panes(df, "t", "pos", late, ["key"])) == brute.session_panes(events, 10, True, -1, 6, 6)
    control = POLICIES["control"]
    repeated = session_panes(
        df, "t", "pos", control, ["key"], moves=F.col("key") == "W", data=F.col("key") != "W", repeat=True, flush=False
    )
    assert got(repeated) == brute.session_panes(
        events, 10, False, 0, 11, 10, True, lambda k: k != "W", lambda k: k == "W", flush=False
    )


@pytest.mark.parametrize(
    "seed, every, chunk, policy, flush",
    [(32, 3, 4, SessionPolicy(10, True, -1, 29, 29), True), (33, 2, 15, SessionPolicy(10, False, 0, 60, 60), False)],
)
def test_early_reports_with_lateness(spark, seed, every, chunk, policy, flush):
    """Counters of sessions merge with them, also where a session is cut into chunks of its rows."""
    # often bridged: rows come up to 35 ticks late, sessions stay for up to 60
    events = disordered(seed, n=140, keys="AAAB", steps=(0, 1, 2, 6, 11, 14))
    panes = session_panes(table(spark, events), "t", "pos", policy, ["key"], early_every=every, max_group_rows=chunk, flush=flush)
    got = sorted((r.pane_kind, r.start, r.end - 10, r.key, r["count"]) for r in panes.collect())
    want = brute.session_panes(events, 10, policy.inclusive, policy.fire, policy.alive, policy.accept, early=every, flush=flush)
    assert got == want
    assert {"early", "late", "on_time"} == {r[0] for r in want}


# a backlog that comes newest first: each row is accepted a round after the one before
BACKLOG = [(300, "A"), (301, "B")] + [(t, "A") for t in range(296, 180, -4)]


def test_early_reports_after_many_rounds(spark):
    """Sizes that Spark expects stay numbers that can be read, however many rounds the late rows took."""
    policy = PROFILES["flink"].session_policy(10)
    got = early_panes(table(spark, BACKLOG), "t", "pos", policy, ["key"], 2).collect()
    want = brute.session_panes(BACKLOG, 10, True, policy.fire, policy.alive, policy.accept, early=2)
    assert sorted((r.pane_kind, r.start, r.end - 10, r.key, r["count"]) for r in got) == want
    assert len(want) > 10


def reports(panes):
    return sorted((r.pane_kind, r.start, r.end - 10, r.key, r["count"]) for r in panes.collect())


def test_session_reports_after_many_rounds(spark, monkeypatch):
    """Where no table is known to be small, the rounds look at expected sizes, and so do the chunks of a session."""
    policy, events = POLICIES["merged_late"], [(315, "B"), *BACKLOG]
    monkeypatch.setattr(session_policies, "MAX_GROUP_ROWS", 3)
    got = session_panes(table(spark, events), "t", "pos", policy, ["key"], max_group_rows=4)
    want = brute.session_panes(events, 10, True, policy.fire, policy.alive, policy.accept)
    assert reports(got) == want
    assert len(want) > 10


def test_early_reports_with_lateness_after_many_rounds(spark, monkeypatch):
    """Early counters of a session in one task, and of one in chunks."""
    policy, events = POLICIES["merged_late"], [*BACKLOG, (315, "B"), (270, "A"), (262, "A")]
    monkeypatch.setattr(session_policies, "MAX_GROUP_ROWS", 3)
    want = brute.session_panes(events, 10, True, policy.fire, policy.alive, policy.accept, early=3)
    for rows_of_a_chunk in (4, 1000):
        got = session_panes(table(spark, events), "t", "pos", policy, ["key"], early_every=3, max_group_rows=rows_of_a_chunk)
        assert reports(got) == want
    assert {"early", "late", "on_time"} == {r[0] for r in want}


def test_an_unreadable_size_counts_as_very_large(spark):
    wide = spark.range(3).withColumn("x", F.lit(1))
    for _ in range(13):
        wide = wide.join(wide.select("id"), "id").checkpoint()
    assert expected_bytes(wide) > 1 << 60
    assert written(wide).count() == 3
    assert expected_bytes(written(wide)) < 1 << 20


def test_parts_unite_like_intervals():
    from tidemark.operators.session_panes import _united

    parts = [(0, 5, 3, False, 70), (30, 30, 1, True, None)]
    more = [(8, 9, 2, False, 90), (5, 5, 0, True, None), (31, 40, 4, False, None)]
    assert _united(parts, more, 3) == [(0, 9, 5, True, 90), (30, 40, 5, True, None)]

"""Fourteen events in two arrival orders, and the parse lines (see FIXTURES.md)."""

import random

INORDER = [(1, "A", 24), (1, "A", 22), (2, "A", 23), (2, "A", 22), (5, "A", 23), (13, "A", 22), (14, "A", 28),
           (15, "A", 23), (19, "A", 30), (23, "A", 7), (26, "A", 15), (27, "W", 0), (30, "W", 0), (500, "W", 0)]
DELAYED = [(13, "A", 22), (15, "A", 23), (26, "A", 15), (27, "W", 0), (23, "A", 7), (1, "A", 24), (2, "A", 23),
           (5, "A", 23), (30, "W", 0), (2, "A", 22), (1, "A", 22), (14, "A", 28), (500, "W", 0), (19, "A", 30)]


def rows(events):
    return [(t, key) for t, key, _ in events]


def table(spark, pairs):
    """``t, key, pos`` in arrival order."""
    return spark.createDataFrame(
        [(t, key, n) for n, (t, key) in enumerate(pairs)], "t bigint, key string, pos bigint"
    )


def disordered(seed, n=120, keys="AAAABW", steps=(0, 1, 1, 2, 3, 8, 25), delays=(0, 0, 1, 5, 9, 10, 11, 20, 35)):
    rnd, now, out = random.Random(seed), 0, []
    for _ in range(n):
        now += rnd.choice(steps)
        out.append((max(0, now - rnd.choice(delays)), rnd.choice(keys)))
    return out


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())

"""Periodic runs against a scan of every lag."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd import documents, none

from tidemark.llm import queries, runs


def plain_runs(words, min_length=12):
    """``(start, length, period)`` of all runs, by start and period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_text(rng):
    words = []
    for _ in range(rng.randrange(6)):
        some = [f"w{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(1, 15))]
        words += (some * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return words


@pytest.mark.parametrize("rounds, probes, min_length", [(24, 1 << 20, 12), (1, 1 << 20, 12), (0, 40, 12), (24, 64, 2), (2, 1 << 20, 5)])
def test_runs_equal_a_plain_scan(monkeypatch, rounds, probes, min_length):
    monkeypatch.setattr(runs, "_ROUNDS", rounds)
    monkeypatch.setattr(runs, "_PROBES", probes)
    rng, total = random.Random(rounds + min_length), 0
    for _ in range(40):
        texts = [made_text(rng) for _ in range(8)]
        got = runs.runs_of([" ".join(t).encode() for t in texts], min_length)
        for words, (_, start, length, period) in zip(texts, got):
            want = plain_runs(words, min_length)
            assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
            total += len(want)
    assert total > 200


def test_a_rare_word_splits_and_pieces_split_again():
    words = "a b u b c x " * 1 + "p q " * 8 + "z " + "p q r " * 5
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words.split()])
    begin, end = runs.surviving(codes, np.array([0]), np.array([len(codes)]), 12)
    assert list(zip(begin.tolist(), end.tolist())) == [(6, 22), (23, 38)]


@pytest.mark.parametrize("words", [["a"] * 60_000, ["a", "b"] * 30_000, list("abaababaabaab") * 4_000])
def test_one_run_as_long_as_the_text(words):
    (_, start, length, period), = runs.runs_of([" ".join(words).encode()])
    whole = (start == 0) & (length == len(words))
    assert whole.sum() == 1 and period[whole][0] <= 13


def test_splits_that_peel_one_word_after_the_other():
    words = ["v1", "u"] + [w for k in range(1, 20_000) for w in (f"v{k + 1}", f"v{k}")]
    (_, start, _, _), = runs.runs_of([" ".join(words).encode()])
    assert not len(start)


def test_odd_rows(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(99, "x y z " * 9, "", "", 1, 1, "", 1, "", 1.0)], documents(spark).schema))
    want = Counter()
    for r in docs.collect():
        words = (r.text or "").split()
        # the two long texts are one run and none
        found = [(0, len(words), 1)] if set(words) == {"long"} else [] if len(set(words)) == len(words) else plain_runs(words)
        want[r.doc_id, len(words), tuple(found), plain_collapsed(words, found)] += 1
    got = runs.periodic_runs(docs)
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in got.collect()) == want
    assert runs.run_digests(runs.periodic_runs(none(spark))).collect() == []
    digests = {r.doc_id: r for r in runs.run_digests(got).collect()}
    assert (digests[99].n_runs, digests[99].start, digests[99].length, digests[99].period, digests[99].exponent_milli) == (1, 0, 27, 3, 9000)
    assert digests[99].runs_sha256 == hashlib.sha256(b"0,27,3\n").hexdigest() and digests[99].collapsed_sha256 == hashlib.sha256(b"x y z").hexdigest()
    assert (digests[1].n_runs, digests[1].start, digests[1].exponent_milli) == (0, None, None)


def test_planted_repeats(spark):
    from zlib import crc32

    docs = documents(spark).select("doc_id", "text")
    want = Counter()
    for r in docs.collect():
        words, h = (r.text or "").split(), None if r.doc_id is None else crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want[r.doc_id, tuple(words)] += 1
    assert Counter((r.doc_id, tuple((r.text or "").split())) for r in queries.with_repeats(docs).collect()) == want

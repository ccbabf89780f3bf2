"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import documents, none

from tidemark.llm import lexical


def terms_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for doc, c, length in counted:
            m = 100 - 50 + (50 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "the lorem4 alpha beta"), (2, "THE a Of é"), (3, None), (4, ""), (5, "nowhere"), (None, "wort haus x1"), (1, "the lorem4 alpha beta"), (2, "ipsum2 dolor1 word")]


@pytest.mark.parametrize("k, slice_terms, block", [(3, 1 << 18, 16 << 20), (50, 4, 16 << 20), (2, 1 << 18, 500), (1, 3, 2_000)])
def test_ranks_equal_a_plain_loop(spark, monkeypatch, k, slice_terms, block):
    monkeypatch.setattr(lexical, "SLICE_TERMS", slice_terms)
    monkeypatch.setattr(lexical, "_BLOCK_BYTES", block)  # goes to the tasks with the function that names it
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    items = items.selectExpr("*", "1 AS doc_id", "'x' AS term", "2 AS score")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)
    got = lexical.ranked(docs, items, k)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) >= 4 * min(k, 2)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(none(spark), items).collect() == []
    assert lexical.ranked(documents(spark), items.filter("false")).collect() == []
    assert lexical.ranked(documents(spark), items.filter("item_id = 5")).collect() == []
    with pytest.raises(ValueError):
        lexical.ranked(documents(spark), items, 0)


def block_of(n_docs, seed):
    rng = np.random.default_rng(seed)
    rows = [np.unique(np.minimum(rng.zipf(1.3, 30), 400)) for _ in range(n_docs)]
    terms = np.concatenate(rows)
    df = np.bincount(terms, minlength=401)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    sizes = np.array([len(r) for r in rows])
    return lexical.Block(sizes, sizes, terms, np.ones(len(terms), np.int64), weights, n_docs, int(sizes.sum())), df


@pytest.mark.parametrize("floor", [1, 10**9, 3 * 10**9])
def test_fewer_accumulators_and_the_same_best(floor):
    block, df = block_of(3_000, 4)
    rng = random.Random(floor)
    fewer = 0
    for _ in range(40):
        terms = np.array(sorted(rng.sample(range(1, 60), 12), key=lambda t: (df[t], t)))
        docs, score = block.search(terms, 5, floor)
        whole = np.zeros(3_000, np.int64)
        for t in terms:
            at = np.searchsorted(block.terms, t)
            if at < len(block.terms) and block.terms[at] == t:
                whole[block.docs[block.cut[at] : block.cut[at + 1]]] += block.share[block.cut[at] : block.cut[at + 1]]
        assert (whole[docs] == score).all()  # survivors are exact
        best = np.sort(whole)[-5:]
        missed = np.setdiff1d(np.flatnonzero((whole >= best[0]) & (whole >= floor) & (whole > 0)), docs)
        assert not len(missed)
        fewer += len(docs) < np.count_nonzero(whole)
        assert not block.alive.any() and not block.accumulators.any()
    assert fewer > 20

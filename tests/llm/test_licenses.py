"""License scans against a plain search."""

import random
import re
from collections import Counter, defaultdict

from odd import documents, none

from tidemark.llm import licenses
from tidemark.llm.licenses import NOTICES, PHRASES, TEMPLATES, Template


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, templates=TEMPLATES):
    """The row of `license_report`, without the id."""
    words, base, labels, base_labels, score = words_of(text), [], set(), set(), 0.0
    for p in templates:
        on, places = defaultdict(set), defaultdict(list)
        for t, g in enumerate(p.grams):
            places[g].append(t)
        for at in range(len(words) - p.gram + 1):
            for t in places.get(" ".join(words[at : at + p.gram]), ()):
                on[at - t].add(t)
        spans, last = [], None
        for d in sorted(on):
            if last is None or d - last > p.slack:
                spans.append((d, set()))
            spans[-1][1].update(on[d])
            last = d
        for d, held in spans:
            share = len(held) / len(p.grams)
            if share >= p.share:
                score = max(score, share)
                labels.add(p.label)
                if p.base:
                    base.append(d)
                    base_labels.add(p.label)
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def made(rng):
    out = []
    for _ in range(rng.randrange(7)):
        words = rng.choice(TEMPLATES).text.split() if rng.random() < 0.6 else [rng.choice(["the", "of", "license", "General", "mit", "é", "Mit", "public,"]) for _ in range(9)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(words))
            words = rng.choice([words[:at] + words[at + 1 :], [*words[:at], "other", *words[at:]], [*words[:at], "else", *words[at + 1 :]]]) or words
        out += words
    return rng.choice([" ", "\n", ". "]).join(out)


def test_reports_equal_a_plain_search(spark):
    rng = random.Random(5)
    rows = [(i, made(rng)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "  -- "), (203, "MIT LICENSE"), (204, "mitİ lİcense mit lİcense"), (205, "(mit license"), (206, "mit license mit license"), (207, "mit licensé"), (208, "Kelvin apache license"), (None, "general public license!"), (3, rows[3][1]), (3, rows[3][1]), (3, "another mit license"), (209, "mit license " * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS th", "1 AS n_words", "'y' AS labels", "2 AS p", "3 AS template")
    want = Counter((doc, *plain(text)) for doc, text in rows)
    got = licenses.license_report(docs)
    assert Counter(tuple(r) for r in got.collect()) == want
    found = {label for row in want for label in row[6].split(",")}
    assert len(found) > 10 and any(0 < row[7] < 1 for row in want)


def test_odd_rows(spark):
    docs = documents(spark)
    assert Counter(tuple(r) for r in licenses.license_report(docs).collect()) == Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert licenses.license_report(none(spark)).collect() == []


def test_spans_follow_an_edited_notice(spark):
    notice = NOTICES[0].text.split()
    edited = ["Before", *notice[:9], "truly", *notice[9:15], *notice[16:], "after"]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(notice[:8]))], "doc_id long, text string")
    spans = licenses.license_spans(docs, [*PHRASES, NOTICES[0]]).collect()
    assert [(r.doc_id, r.label, r.start, r.end) for r in spans] == [(1, "mit-grant", 1, len(edited) - 1)]
    assert 0.6 <= spans[0].share < 1


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "all rights reserved by us"), (2, "rights all")], "doc_id long, text string")
    rows = licenses.license_report(docs, [Template("arr", "All rights reserved", 1.0, True)]).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.labels) for r in rows) == [(1, 1, 0, "arr"), (2, 0, None, "")]


def test_no_python_runs_on_the_way(spark):
    plan = licenses.license_report(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

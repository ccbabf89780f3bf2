"""Learned operators: held-out accuracy, recall and round trips."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import documents, none
from tokenizers import Tokenizer

from tidemark.llm import language, neighbours, packing, quality

SF = "/root/testdata/sf0.01"


def crc_mod(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(scores) == docs.count()
    assert all(r.held_out == (crc_mod(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in scores.items())
    held = [(scores[r.doc_id].predicted, r.quality) for r in labels.collect() if scores[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held) and {q for _, q in held} == {0, 1}
    # labels of held-out documents are never used
    other = labels.withColumn("quality", (1 - labels.quality).cast("int")).filter("crc32(cast(doc_id AS string)) % 5 = 0")
    mixed = labels.filter("crc32(cast(doc_id AS string)) % 5 <> 0").unionByName(other)
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, mixed).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in scores.items())


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, None, 1), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (60, 61)}) == 1  # null and empty
    nothing = quality.quality_scores(docs, labels.filter("false")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality.quality_scores(none(spark), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_isotonic_fit():
    got = quality.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 3, 1]))
    assert np.allclose(got, [0.1, 0.35, 0.35, 0.9])


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    n = len(quality.STATISTICS)
    model = quality.Model(np.zeros(n), np.ones(n), rng.standard_normal((n, 20_000)) / 6, rng.uniform(0, 2 * np.pi, 20_000), None, None, None)
    x = rng.standard_normal((6, n))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 72)
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (crc_mod(d, 4) == 2) for d, r in found.items())
    held = [(r.lang_pred, truth[d]) for d, r in found.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, g, 1) for i, (t, g) in enumerate([("the cat of the house", "en"), ("der hund und das haus", "de")] * 20 + [("123 !!", "en"), (None, "en"), ("", None), ("the house", None)])]
        + [(None, "das haus", "de", 1), (0, "the cat of the house", "en", 1)], "doc_id long, text string, lang string, score int")
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (40, 41, 42)] == [("und", 0.0)] * 3
    assert by[43].lang_pred == "en" and by[None].lang_pred == "de" and 0.5 < by[43].score <= 1
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("false")).collect()} == set()
    assert {r.lang_pred for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def plain_languages(rows):
    """Naive Bayes over hashed runs of one to three characters, count by count."""
    def hashes(text):
        x = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        for size in (1, 2, 3):
            for i in range(len(x) - size + 1):
                if set(x[i : i + size]) == {32}:
                    continue
                h = x[i] * (0x165667B1 if size == 1 else 0x9E3779B1) % 2**32
                if size > 1:
                    h ^= x[i + 1] * 0x85EBCA77 % 2**32
                if size > 2:
                    h = h * 0xC2B2AE3D % 2**32 ^ x[i + 2] * 0x27D4EB2F % 2**32
                h = (h + size - 1) % 2**32
                h ^= h >> 15
                yield (h * 0x2C1B3C6D % 2**32) >> 18
    seen = {}
    for doc, text, lang in rows:
        if crc_mod(doc, 4) != 2 and text is not None and lang is not None:
            seen.setdefault(lang, Counter()).update(hashes(text))
    out = {}
    for doc, text, _ in rows:
        own = Counter(hashes(text or ""))
        total = {}
        for lang in sorted(seen):
            norm = sum(seen[lang].values()) + language.ALPHA * language.BUCKETS
            total[lang] = sum(n * math.log((seen[lang][b] + language.ALPHA) / norm) for b, n in own.items())
        best = max(total, key=total.get) if own and total else None
        out[doc] = (best, 1 / sum(math.exp(t - total[best]) for t in total.values())) if best else ("und", 0.0)
    return out


def test_languages_against_a_plain_version_in_slices(spark):
    """Any number of languages to a pass gives what one pass gives."""
    rnd = random.Random(3)
    words = [["".join(rnd.choice("abcdefghijklmn\u00e9\u00fc"[k : k + 9]) for _ in range(rnd.randrange(1, 6))) for _ in range(12)] for k in range(7)]
    rows = [(i, " ".join(rnd.choices(words[i % 7], k=rnd.randrange(0, 9))) + rnd.choice(["", ".", " 12"]), f"l{i % 7}") for i in range(300)]
    rows += [(1000, None, "l1"), (1001, "123", "l2"), (1002, words[3][0], None), (1003, words[3][1], "never seen" * 1000), (1004, "...", "only signs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    plain = plain_languages(rows)
    for size in (None, 1, 3, 9):
        found = {r.doc_id: r for r in language.identify(docs, languages=size).collect()}
        assert len(found) == len(rows)
        for doc, (lang, score) in plain.items():
            assert found[doc].lang_pred == lang and abs(found[doc].score - score) < 1e-9


def test_three_thousand_languages(spark):
    name = lambda i: "".join(chr(0x4E00 + (i * 7 + k) % 20_000) for k in range(3))
    rows = [(2 * i + fold, f"{name(i)} {name(i)}", f"{i:04d}") for i in range(3000) for fold in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = {lang for doc, _, lang in rows if crc_mod(doc, 4) != 2}
    found = language.identify(docs, languages=1500).collect()
    known = [r for r in found if f"{r.doc_id // 2:04d}" in learned]
    assert len(found) == 6000 and len(known) > 5000
    assert sum(r.lang_pred == f"{r.doc_id // 2:04d}" for r in known) >= 0.9 * len(known)


def sequential(totals, shares, window, chunk):
    """Deficit round-robin as a loop: (queue, chunk number) in the order of service."""
    quantum = [max(1, int(np.floor(s / sum(shares) * window * 1024))) for s in shares]
    deficit, done, out = [0] * len(totals), [0] * len(totals), []
    while any(d < t for d, t in zip(done, totals)):
        for q, t in enumerate(totals):
            if done[q] < t:
                deficit[q] += quantum[q]
                while done[q] < t and (size := min(chunk, t - done[q])) * 1024 <= deficit[q]:
                    out.append((q, done[q] // chunk, size))
                    deficit[q] -= size * 1024
                    done[q] += size
    return out


@pytest.mark.parametrize("shares", [None, [1, 1, 1, 1], [5, 1, 0.01, 2]])
def test_places_equal_a_round_robin_loop(shares):
    totals = [10_000, 1, 5_003, 777]
    shares = shares or totals
    order, at = sequential(totals, shares, 512, 64), 0
    rounds = packing.Rounds(totals, shares, 512, 64)
    for q, j, size in order:
        assert rounds.place(np.array([q]), np.array([j]))[0] == at
        at += size
    # every window has each queue's share, but for a chunk, while all last
    served = rounds.served(np.arange(0, 10))
    want = np.minimum(np.arange(0, 10)[:, None] * rounds.quantum / 1024, totals)
    assert (np.abs(served - want) <= 64 + 1).all()


def test_packing_is_an_exact_round_trip(spark):
    docs = documents(spark)
    rows = packing.pack(docs, window=256, chunk=32).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    ids = {}
    for r in docs.collect():
        got = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r.doc_id, []).append(got)
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    end = 0
    for r in rows:
        assert r.sequence_id * 256 + r.offset == end and r.offset + r.length <= 256
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        end += r.length
    assert end == sum(len(x) for many in ids.values() for x in many)
    places = Counter((r.doc_id, r.doc_tokens, r.start) for r in rows if r.doc_id == 5)
    assert all(n >= 3 for (_, _, start), n in places.items() if start == 0)
    assert packing.pack(none(spark)).count() == 0


def test_queues_beyond_what_a_task_knows_give_the_same_places(spark):
    docs = documents(spark)
    key = lambda r: tuple(r)
    for targets in (None, {r.source: 1.0 + i for i, r in enumerate(docs.select("source").distinct().orderBy("source").collect()) if r.source}):
        few, many = (sorted(map(key, packing.pack(docs, targets=targets, window=256, chunk=32, most_queues=most).collect()), key=str) for most in (1024, 1))
        assert few == many and few


def test_three_thousand_sources_keep_their_shares(spark):
    """A named target holds its share of every window however many other sources there are; the others keep theirs."""
    rows = [(i, "a b c d e f g", f"s{i % 3000:04d}") for i in range(6000)] + [(10_000 + i, "x y z " * 33, "big") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = packing.pack(docs, targets={"big": 3000.0, "s0000": 1.0}, window=2048, chunk=16).collect()
    out.sort(key=lambda r: (r.sequence_id, r.offset))
    end = 0
    for r in out:
        assert r.sequence_id * 2048 + r.offset == end
        end += r.length
    assert end == 6000 * 8 + 300 * 100
    # "big" has 3,000 of 3,000 * 1,500.5 + 3,000 parts without own targets given: the mean of both is the others' share
    shares = {"big": 3000.0, "s0000": 1.0} | {f"s{i:04d}": 1500.5 for i in range(1, 3000)}
    queues = sorted(shares)
    totals = {q: 30_000 if q == "big" else 16 for q in queues}
    rounds = packing.Rounds([totals[q] for q in queues], [shares[q] for q in queues], 2048, 16)
    at = {q: i for i, q in enumerate(queues)}
    source = {i: s for i, _, s in rows}
    first = {}
    for r in out:
        q = source[r.doc_id]
        first[q] = min(first.get(q, 1 << 60), r.sequence_id * 2048 + r.offset)
    for q in ["big", *queues[1::97]]:
        assert first[q] == rounds.place(np.array([at[q]]), np.array([0]))[0]


def test_word_by_word_ids_equal_whole_texts():
    tokenizer = packing.WordTokenizer(packing.default_vocabulary())
    texts = ["It's HERE, isn't it? ", "a<|endoftext|>b <|EndOfText|>", "x́ e ́a İ Σ abcΣ \x1c q\x85z​ Å", None, "", "123 4é5!!*** \U0001F600", "क़ ab\x00cd"]
    want = [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, tokenizer.kind).tolist() for x in tokenizer([t and t.encode() for t in texts])] == want


def test_a_word_is_looked_up_once_for_all_its_places(monkeypatch):
    tokenizer = packing.WordTokenizer(packing.default_vocabulary())
    asked = Counter()

    class Counting(packing._Known):
        def get(self, word, default=None):
            asked[word] += 1
            return super().get(word, default)

        def __getitem__(self, word):
            asked[word] += 1
            return super().__getitem__(word)

    known = Counting()
    known.update(tokenizer.known)
    tokenizer.known = known
    texts = ["one two " * 500, " Two\u00a0x three.\tone\x0b\x0c", None, "", "\n", "one two <|EndOfText|> three. " * 300]
    want = [tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]

    def ids():
        return [np.frombuffer(x, tokenizer.kind).tolist() for x in tokenizer([t and t.encode() for t in texts])]

    assert ids() == want
    assert asked[b"one"] >= 1 and max(asked.values()) < 10
    monkeypatch.setattr(packing, "_PART_BYTES", 7)  # texts in parts of their own, words that there is no room for
    monkeypatch.setattr(packing, "_MOST_WORDS", 2)
    known.clear()
    known[b""] = b""
    assert ids() == want


def test_words_apart_from_punctuation_have_the_ids_of_whole_texts():
    tokenizer, rng = packing.WordTokenizer(packing.default_vocabulary()), random.Random(5)
    signs = [*"aAzsÉßÿ×Σ\u0131\u017f'.,;:!?*%$#&|)(<>- 1²\t\u6f22\u0301\u0327\u00ad\u200d", "'s", "'ll", "<|", "e\u0301", "one", "one.", "one,"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)]
    want = [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, tokenizer.kind).tolist() for x in tokenizer([t.encode() for t in texts])] == want
    tokenizer([b"one! one? one"])
    assert b"one" in tokenizer.known and b"one!" not in tokenizer.known


def test_recall_of_nearest_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in neighbours.nearest(vectors, vectors.vec_id % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        got = sorted(found[ids[i]])
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(abs(g[2] - score[np.flatnonzero(ids == g[1])[0]]) < 1e-12 for g in got)
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hits += len({g[1] for g in got} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_neighbours_of_odd_rows(spark):
    rng = random.Random(4)
    same = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, same, i) for i in range(60)] + [(100 + i, [3 * rng.gauss(0, 1) for _ in range(8)], i) for i in range(40)]
    rows += [(200, None, 0), (220, [0.0] * 8, 0), (240, [1.0] * 7 + [float("nan")], 0), (260, [1.0] * 7 + [None], 0), (280, [1.0] * 9, 0), (None, same, 0), (0, same, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    good = {r[0]: np.array(r[1]) for r in rows[:100]}
    found = {}
    for r in neighbours.nearest(vectors, vectors.vec_id % 20 == 0, k=30).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == {0, 20, 40, 100, 120}
    hits = 0
    for q, got in found.items():
        want = [v for _, v in sorted((-float((good[v] * good[q]).sum()), v) for v in good if v != q)][:30]
        hits += len(set(want) & {v for _, v in got})
        assert len(got) == 30 and q not in {v for _, v in got}
    assert hits >= 0.9 * 30 * len(found)
    # all candidates, if there are fewer
    few = vectors.filter("vec_id IN (0, 1, 100)")
    assert sorted((r.query_id, r["rank"]) for r in neighbours.nearest(few, few.vec_id % 20 == 0).collect()) == [(0, 1), (0, 2), (100, 1), (100, 2)]
    assert neighbours.nearest(vectors.filter("false"), vectors.vec_id % 20 == 0).count() == 0


def test_many_parts_find_the_same(spark, monkeypatch):
    """Parts and slices change who looks where, not what is found."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 300")

    def found():
        return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(vectors, vectors.vec_id % 20 == 0, k=10).collect()}

    whole = found()
    monkeypatch.setattr(neighbours, "_PART_BYTES", 64 * 8 * 50)
    monkeypatch.setattr(neighbours, "_PART_QUERIES", 4)
    assert found() == whole and len(whole) == 150


def test_substrings_hold_real_bits_only():
    """Unit vectors have no length to speak of: 2 x 64 bits, four substrings of 32, none of padding."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    coder = neighbours.learn_coder(x, float(np.sqrt((x * x).sum(1).max())))
    assert coder.axes.shape[1] == 128 and coder.substrings == 4 and coder.widths == [32] * 4
    codes = coder.of_rows(x)
    assert all(len(np.unique(codes[:, t])) > 3900 for t in range(4))
    odd = neighbours.Coder(np.zeros(9), np.eye(9, 65), 1.0)
    assert odd.widths == [22, 22, 21] and odd.of_rows(np.ones((1, 8))).tolist() == [[(1 << 8) - 1, 0, 0]]


def test_groups_stay_within_their_bound(spark, monkeypatch):
    """A part with most of the vectors is dealt to several groups, and the same is found."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)) * 0.01 + np.array([5.0] + [0.0] * 7)
    x[:20] += rng.standard_normal((20, 8)) * 3
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")

    def found():
        return {(r.query_id, r["rank"]): r.vec_id for r in neighbours.nearest(vectors, vectors.vec_id % 20 == 0, k=5).collect()}

    whole, sizes = found(), []
    monkeypatch.setattr(neighbours, "_PART_BYTES", 64 * 40)
    monkeypatch.setattr(neighbours, "_PART_QUERIES", 8)
    group_by = type(vectors).groupBy

    def watched(df, *keys):
        if "share" in [k for k in keys if isinstance(k, str)]:
            sizes.extend((r["query"], r["count"]) for r in group_by(df, *keys, "query").count().collect())
        return group_by(df, *keys)

    monkeypatch.setattr(type(vectors), "groupBy", watched)
    assert found() == whole
    # dealt by a hash, so about the bound
    assert max(n for query, n in sizes if not query) <= 60 and max(n for query, n in sizes if query) <= 20

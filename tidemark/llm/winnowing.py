"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every ``w`` neighbouring k-grams. A window of ``k + w - 1`` words or more
keeps a k-gram wherever it stands, so a document that has a window of an item shares a kept k-gram with it. Kept k-grams
are joined; documents with shared ones are looked at again, and each shared k-gram is extended to the windows around it,
which are joined with the items' windows by a 128-bit hash.

``k`` and ``w`` follow the shortest window of the items, so the guarantee holds for items of any length. The items' side
of a join is broadcast only if it was counted and is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Codes, broadcast_if_below, emit, flushes, give_back, ngram_hashes, row_key, same_row, text_bytes, within
from tidemark.session import in_parts, materialise

BUFFER_BYTES = 12 << 20

#: Lower-cases A-Z; ASCII bytes other than letters and digits become spaces.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_KEPT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64())])
_WINDOWS = pa.schema([("item_id", pa.string()), ("len", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])
_ITEM_KEPT = pa.schema([("h", pa.int64())])
_AROUND = pa.schema([
    ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())),
    ("lens", pa.list_(pa.int64())), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())),
])

_codes = Codes()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each ``width`` neighbours."""
    size, done = len(x) - width + 1, 1
    if size <= 0:
        return x[:0]
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def kept_kgrams(codes: np.ndarray, lengths: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of k-grams that are smallest in some run of ``w`` (in texts laid end to end)."""
    hashes = ngram_hashes(codes, k)
    if len(hashes) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # the smallest of each run inside a text; 0 for runs that cross a border (no hash is 0 but by chance, which only keeps more)
    least = np.where(within(lengths, k + w - 1), _sliding(hashes, w, np.minimum), np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == hashes)
    return at, hashes[at]


def _lay(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    codes = [_codes.of(words_of(t)) for t in texts]
    return (np.concatenate(codes) if codes else np.empty(0, np.uint64)), np.array([len(c) for c in codes], np.int64)


def _pair(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of ``n`` words."""
    return ngram_hashes(codes, n, 1 << 20).view(np.int64), ngram_hashes(codes, n, 1 << 21).view(np.int64)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """``item_id, len, w1, w2``: every window of every item; an item with fewer words is one window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))):
                codes = _codes.of(words_of(text))
                if len(codes):
                    n = min(window, len(codes))
                    w1, w2 = _pair(codes, n)
                    yield emit({"item_id": [item] * len(w1), "len": np.full(len(w1), n), "w1": w1, "w2": w2}, _WINDOWS)

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "item_id string, len int, w1 long, w2 long")


def _kept_of_items(items: DataFrame, window: int, k: int, w: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield emit({"h": np.unique(kept_kgrams(*_lay(text_bytes(batch.column("text"))), k, w)[1]).view(np.int64)}, _ITEM_KEPT)

    return items.select(F.col("text").cast("string").alias("text")).mapInArrow(of, "h long").distinct()


def _kept_of_documents(rows: DataFrame, k: int, w: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches, BUFFER_BYTES):
            codes, lengths = _lay(text_bytes(table.column("text")))
            at, h = kept_kgrams(codes, lengths, k, w)
            row = np.repeat(np.arange(len(lengths)), lengths)[at]
            ids = table.column("doc_id").combine_chunks().take(pa.array(row))
            yield emit({"doc_id": ids, "th": table.column("th").to_numpy()[row], "h": h.view(np.int64)}, _KEPT)
            del codes, at, h, row, ids
            give_back()

    return rows.mapInArrow(of, "doc_id long, th long, h long")


def _windows_around(rows: DataFrame, k: int, w: int, lens: list[int]) -> DataFrame:
    """For every row its number of words and the windows of each length around its shared k-grams (``hits``)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, th, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th")), text_bytes(batch.column("text")), batch.column("hits").to_pylist()):
                words = words_of(text)
                starts, sizes, first, second = [], [], [], []
                if hits:
                    codes = _codes.of(words)
                    at, h = kept_kgrams(codes, np.array([len(codes)]), k, w)
                    at = at[np.isin(h, np.array(hits, np.int64).view(np.uint64))]
                    for n in lens:
                        begin = np.unique((at[:, None] - np.arange(n - k + 1)).ravel())
                        begin = begin[(begin >= 0) & (begin <= len(codes) - n)]
                        if len(begin):
                            w1, w2 = _pair(codes, n)
                            starts += begin.tolist()
                            sizes += [n] * len(begin)
                            first += w1[begin].tolist()
                            second += w2[begin].tolist()
                out.append((doc, th, len(words), starts, sizes, first, second))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_AROUND)], schema=_AROUND)
            give_back()

    return rows.mapInArrow(of, "doc_id long, th long, n_words long, starts array<long>, lens array<long>, w1 array<long>, w2 array<long>")


# Words that lie in spans (start, len), which are in order of start.
_COVERED = """aggregate(array_sort(spans), struct(0L AS upto, 0L AS n), (a, s) -> struct(
    greatest(a.upto, s.start + s.len) AS upto, a.n + greatest(0L, s.start + s.len - greatest(a.upto, s.start)) AS n), a -> a.n)"""


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, kgram: int = 5, one_in: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of ``docs``.

    A word is hit if it lies in a run of words that is a window of an item (``window`` neighbouring words; an item of
    fewer words is one window). ``items`` are the ids, as sorted strings, of the items with such a window, and
    ``contaminated`` means that words are hit, and at least one in ``one_in``. Words are ASCII letters and digits and all
    other characters beyond ASCII, in any ASCII case.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``; other columns are not looked at. Null and
    empty texts have no words, are never hit and hit nothing. Rows are returned as often as they come, rows without id
    too. An item without id hits words but is not listed. Without documents the result is empty; without items nothing
    is hit.
    """
    return _found(docs, items, window, kgram, one_in)[0]


def _found(docs: DataFrame, items: DataFrame, window: int, kgram: int, one_in: int) -> tuple[DataFrame, DataFrame]:
    """What `contamination` returns, and a written table with as many rows."""
    windows = materialise(windows_of(items, window))
    sizes = windows.groupBy("len").count().collect()  # at most ``window`` rows
    lens, n_windows = sorted(r["len"] for r in sizes), sum(r["count"] for r in sizes)
    shortest = lens[0] if lens else window
    k = min(kgram, shortest)
    w = shortest - k + 1

    rows = row_key(docs)
    kept = materialise(in_parts(_kept_of_items(items, window, k, w), n_windows))
    shared = _kept_of_documents(rows, k, w).join(broadcast_if_below(kept, kept.count(), 64), "h")
    hits = shared.groupBy("doc_id", "th").agg(F.collect_set("h").alias("hits"))
    with_hits = rows.join(hits, same_row(rows, hits), "left").select(rows["doc_id"], rows["th"], "text", "hits")
    around = materialise(_windows_around(with_hits, k, w, lens))

    spots = around.filter("size(starts) > 0").select("doc_id", "th", F.explode(F.arrays_zip("starts", "lens", "w1", "w2")).alias("s")).select(
        "doc_id", "th", F.col("s.starts").alias("start"), F.col("s.lens").cast("int").alias("len"), F.col("s.w1").alias("w1"), F.col("s.w2").alias("w2")).distinct()
    known = windows.groupBy("len", "w1", "w2").agg(F.collect_set("item_id").alias("ids"))
    matched = (
        spots.join(broadcast_if_below(known, n_windows, 256), ["len", "w1", "w2"])
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("start", F.col("len").cast("long").alias("len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        .select("doc_id", "th", F.expr(_COVERED).alias("n_hit"), F.array_sort("ids").alias("items"))
    )
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    found = (
        around.select("doc_id", "th", "n_words").alias("d").join(matched.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.th = m.th"), "left")
        .select("d.doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("items"), ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))
    )
    return found, around


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, kgram: int = 5, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated (see `contamination`), with all their columns. Rows of one id
    go together if any of them is contaminated; a row without id stays."""
    found, around = _found(docs, items, window, kgram, one_in)
    away = found.filter("contaminated").select(F.col("doc_id").alias("_away")).distinct()
    away = materialise(in_parts(away, around.count()))
    return docs.join(broadcast_if_below(away, away.count(), 64), F.col("doc_id").cast("long") == F.col("_away"), "left_anti").select(*docs.columns)

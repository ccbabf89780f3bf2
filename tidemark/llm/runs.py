"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words that repeats itself at a smallest period at least twice and cannot be longer at that period.
Within a segment of a text, a word that has no other occurrence within half the segment's length joins no run in it, so
it splits the segment; so do its pieces in turn, until none splits any more. Pieces shorter than a run are done with. Most
of an ordinary text is gone by then.

What survives is scanned lag by lag. At a lag of ``q`` a run is a stretch of places whose word comes again ``q`` later, so
a few evenly spaced places meet every stretch that is long enough: blocks of 2^j words are ranked (equal rank, equal
words), the blocks at such a place and ``q`` later are compared, and where they are equal the stretch is followed both ways
over the ranks. The work is a text's length times a power of its logarithm, also for texts that are one run.

A document is scanned in one task, with memory in proportion to its words; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrays_of, arrow_schema, emit, flushes, text_bytes

# Words are what lies between these bytes (fixed values: space and the controls 9 to 13).
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

# Places compared at once, and bytes of text that are split together.
_PROBES = 1 << 20
_BATCH_BYTES = 4 << 20
# So many rounds split all segments at once; segments that still change then are split from their ends.
_ROUNDS = 24
_RESULT = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


class _Numbers(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the places of the same code before and after it (-1 and the length, if none)."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _rare(at: np.ndarray, begin: np.ndarray, end: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Is the word at these places, in segments ``begin:end``, too rare for a run? Both its neighbours of the same word
    lie outside, or further away than a period can be."""
    most = (end - begin) // 2
    prev, next_ = before[at], after[at]
    return ((prev < begin) | (at - prev > most)) & ((next_ >= end) | (next_ - at > most))


def _cut(at: np.ndarray, rare: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int):
    """Segments left of ``begin:end`` (given for each of their places ``at``) without the rare places."""
    keep = ~rare
    new = keep & np.concatenate([[True], rare[:-1] | (begin[1:] != begin[:-1])])
    starts = at[new]
    lengths = np.bincount(np.cumsum(new)[keep] - 1, minlength=len(starts))
    touched = (end - begin)[new] != lengths
    long = lengths >= min_length
    return starts[long], starts[long] + lengths[long], touched[long]


def _places(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of segments, and the number of the segment each is in."""
    lengths = end - begin
    owner = np.repeat(np.arange(len(begin)), lengths)
    return np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + begin[owner], owner


def _split_from_ends(begin: int, end: int, before: np.ndarray, after: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """What is left of one segment. It is looked through from both ends in growing steps, so that a split costs no more than
    its shorter side."""
    left, stack = [], [(begin, end)]
    while stack:
        s, e = stack.pop()
        if e - s < min_length:
            continue
        done, step, found = 0, 64, np.empty(0, int)
        while done < (e - s + 1) // 2 and not len(found):
            reach = min(done + step, (e - s + 1) // 2)
            at = np.unique(np.concatenate([np.arange(s + done, s + reach), np.arange(e - reach, e - done)]))
            found = at[_rare(at, np.full(len(at), s), np.full(len(at), e), before, after)]
            done, step = reach, 2 * step
        if len(found):
            stack += zip([s, *(found + 1).tolist()], [*found.tolist(), e])
        else:
            left.append((s, e))
    return left


def surviving(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of ``begin:end`` (texts, whose codes are all different from each other's) in which no word is too rare."""
    before, after = _neighbours(codes)
    long = end - begin >= min_length
    begin, end = begin[long], end[long]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(_ROUNDS):
        if not len(begin):
            break
        at, owner = _places(begin, end)
        rare = _rare(at, begin[owner], end[owner], before, after)
        new_begin, new_end, touched = _cut(at, rare, begin[owner], end[owner], min_length)
        done.append((new_begin[~touched], new_end[~touched]))
        begin, end = new_begin[touched], new_end[touched]
    for s, e in zip(begin.tolist(), end.tolist()):
        pieces = np.array(_split_from_ends(s, e, before, after, min_length), int).reshape(-1, 2)
        done.append((pieces[:, 0], pieces[:, 1]))
    if not done:
        return begin, end
    begin, end = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begin)
    return begin[order], end[order]


def _block_ranks(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... words from each place: equal ranks are equal words, -1 a block that comes once. A
    block that comes once stays alone when it grows, so only repeated ones go on."""
    ranks, size = [], 1
    here, key = np.arange(len(codes)), codes
    while True:
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.full(len(codes), -1, np.int32)
        repeated = counts[inverse] > 1
        rank[here[repeated]] = (np.cumsum(counts > 1) - 1)[inverse[repeated]]
        ranks.append(rank)
        here = np.flatnonzero(rank[: len(codes) - size] >= 0) if len(codes) > size else np.empty(0, int)
        here = here[rank[here + size] >= 0]
        if not len(here) or 2 * size > longest:
            return ranks
        key = rank[here].astype(np.int64) * len(codes) + rank[here + size]
        size *= 2


def _follow(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, forwards: bool) -> np.ndarray:
    """How many words from ``a`` on (or before ``a``) equal those at ``b``."""
    total, n = np.zeros(len(a), np.int64), len(ranks[0])
    for j in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << j, ranks[j]
        # the largest block may fit more than once
        going = np.ones(len(a), bool)
        while going.any():
            x, y = (a + total, b + total) if forwards else (a - total - size, b - total - size)
            inside = going & (x >= 0) & (y >= 0) & (x < n) & (y < n)
            going = np.zeros(len(a), bool)
            going[inside] = (rank[x[inside]] >= 0) & (rank[x[inside]] == rank[y[inside]])
            total[going] += size
            if j < len(ranks) - 1:
                break
    return total


def lag_scan(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of at least ``min_length`` words inside the segments, by start and period."""
    at, owner = _places(begin, end)
    # the segments' words end to end, each followed by a word that comes nowhere else
    first = np.cumsum(end - begin + 1) - (end - begin + 1)
    laid = -1 - np.arange(len(at) + len(begin), dtype=np.int64)
    laid[at - begin[owner] + first[owner]] = codes[at]
    size = end - begin
    ranks = _block_ranks(laid, int(size.max(initial=1)))
    # every segment with every lag that fits twice, as far as there are repeated blocks of the size that is compared
    most = np.minimum(size // 2, max(min_length, 4 << len(ranks)))
    seg = np.repeat(np.arange(len(begin)), most)
    lag = np.arange(len(seg)) - np.repeat(np.cumsum(most) - most, most) + 1
    need = np.maximum(lag, min_length - lag)
    step = (need + 1) // 2
    level = np.frexp((need // 2 + 1).astype(float))[1] - 1
    wanted = level < len(ranks)
    seg, lag, need, step, level = (x[wanted] for x in (seg, lag, need, step, level))
    counts = np.maximum(0, -(-(size[seg] - lag) // step))
    cuts = np.searchsorted(np.cumsum(counts), np.arange(_PROBES, int(counts.sum()) + _PROBES, _PROBES))
    found, low = [np.empty((0, 3), np.int64)], 0
    for high in [*(cuts + 1).tolist(), len(seg)]:
        part = slice(low, high)
        low = max(low, high)
        pair = np.repeat(np.arange(len(seg))[part], counts[part])
        if not len(pair):
            continue
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        x = first[seg[pair]] + nth * step[pair]
        y = x + lag[pair]
        equal = np.zeros(len(pair), bool)
        for j in np.unique(level[part]).tolist():
            of = np.flatnonzero(level[pair] == j)
            equal[of] = (ranks[j][x[of]] >= 0) & (ranks[j][x[of]] == ranks[j][y[of]])
        pair, x, y = pair[equal], x[equal], y[equal]
        back, on = _follow(ranks, x, y, False), _follow(ranks, x, y, True)
        long = back + on >= need[pair]
        q = lag[pair[long]]
        found.append(np.unique(np.stack([(x - back)[long], (back + on)[long] + q, q], axis=1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch has its multiples of the smallest period as periods too; rows are in order of period within start and length
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])] if len(runs) else runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    home = np.searchsorted(first, runs[:, 0], side="right") - 1
    return runs[:, 0] - first[home] + begin[home], runs[:, 1], runs[:, 2]


def runs_of(texts: list[bytes | None], min_length: int = 12) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words and the starts, lengths and periods of its runs."""
    words = [_WORD.findall(t) if t else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    numbers = _Numbers()
    plain = np.fromiter((n for w in words for n in map(numbers.__getitem__, w)), np.int64, int(lengths.sum()))
    codes = plain + np.repeat(np.arange(len(texts)), lengths) * max(1, len(numbers))
    begin, end = surviving(codes, ends - lengths, ends, min_length)
    start, length, period = lag_scan(codes, begin, end, min_length)
    cut = np.searchsorted(start, np.concatenate([[0], ends]))
    for i, w in enumerate(words):
        part = slice(cut[i], cut[i + 1])
        yield w, start[part] - (ends[i] - lengths[i]), length[part], period[part]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: for every row the number of its words, its runs of ``min_length`` words and more
    (an array of ``start, length, period``, in words from 0, by start and then period) and its text without repeats: a word
    that some run contains after its first period is dropped, the others are joined by one space.

    Every row of ``docs`` comes back, as often as it comes, rows without an id too; an empty table gives an empty one. A null
    or empty text has no words, no runs and an empty ``collapsed``. Of runs over the same words the one with the smallest
    period is meant; different runs may overlap. Texts of any length are scanned whole, each in one task. Columns other
    than ``doc_id`` and ``text`` are not looked at.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    schema = arrow_schema(_RESULT)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches, _BATCH_BYTES):
            found = list(runs_of(text_bytes(table.column("text").combine_chunks()), min_length))
            sizes = [len(s) for _, s, _, _ in found]
            columns = {
                "doc_id": table.column("doc_id").combine_chunks(),
                "n_words": [len(w) for w, _, _, _ in found],
                "collapsed": pa.array([collapsed(*f) for f in found], pa.binary()).cast(pa.string()),
            }
            for k, name in enumerate(("starts", "lengths", "periods"), 1):
                columns[name] = arrays_of([f[k] for f in found], sizes, pa.int64())
            yield emit(columns, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return rows.mapInArrow(of, _RESULT).select("doc_id", "n_words", zipped.alias("runs"), "collapsed")


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of `periodic_runs`: how many runs, the longest one (ties: smallest start, then period; nulls if there is
    none) with ``exponent_milli``, its length in thousandths of its period, and digests of all runs and of the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        found.withColumn("_best", F.when(F.size("runs") > 0, best))
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.n")).alias("length"),
            F.col("_best.p").alias("period"), F.expr("(1000 * -_best.n) div _best.p").alias("exponent_milli"),
            F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )

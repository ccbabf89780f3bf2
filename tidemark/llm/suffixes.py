"""Repeated passages by hashes of suffixes' first words, in bins by prefix, in place of suffix trees.

Every word starts a suffix. Prefixes split the suffixes into groups that fit in memory: a prefix that too many suffixes
share is made one word longer, until its groups are small or it is ``window`` words long. A group is one bin of a shuffle.
Of a suffix tree only nodes at least ``window`` words deep would matter, so a suffix is sent as a hash of its first ``window``
words, and sorting a group's hashes brings the leaves under one such node together; a node with leaves in several documents
is a repeat. Suffixes are not ordered beyond that depth and there are no deeper nodes: neighbouring suffixes of a document
that repeat join to passages, whichever documents they are shared with.

Before anything is sent, each task looks at the documents it holds: leaves that repeat there are settled on the spot, and
only the first document of each node is sent. A passage that is in a third of all documents thus costs a row per task and
not a row per document. What the subtrees find goes back by document shard, as the numbers of the leaves in the document's
share of the group, and meets the whole text there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Codes, arrow_schema, flushes, mix, multipliers, ngram_hashes, row_key, shuffle_partitions, text_bytes, within
from tidemark.session import materialise

# Suffixes of one group, at most (but for those that a whole window makes equal), and text bytes of one shard and task buffer.
GROUP_SUFFIXES = 8 << 20
SHARD_BYTES = 16 << 20
BUFFER_BYTES = 8 << 20

_COUNTS = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("n", pa.int64())])
# a negative bin holds leaves that a task has settled already, for shard -1 - bin
_LEAVES = pa.schema([("bin", pa.int32()), ("leaves", pa.binary())])
_FOUND = pa.schema([("shard", pa.int32()), ("found", pa.binary())])

_codes = Codes()


def pack(*arrays: np.ndarray) -> bytes:
    """Number arrays in one value: their sizes, then their bytes, each array's bytes by place (so that they compress)."""
    head = np.array([len(arrays)] + [v for a in arrays for v in (a.dtype.itemsize, len(a))], "<i8").tobytes()
    return head + b"".join(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize < 8 else a.tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", 2 * count, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * count
    for width, n in sizes.tolist():
        raw = np.frombuffer(data, np.uint8, width * n, at)
        out.append((np.ascontiguousarray(raw.reshape(width, n).T) if width < 8 else raw).reshape(-1).view(f"<u{width}"))
        at += width * n
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32)


@dataclass
class Split:
    """The prefixes that are made longer, by length, and the number of bins their groups are dealt to."""

    window: int
    bins: int
    long: dict[int, np.ndarray] = field(default_factory=dict)

    def bins_of(self, codes: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """The bin of each valid suffix (a run of ``window`` codes stays in its text)."""
        at = np.flatnonzero(valid)
        prefix, group = prefix_hash(codes[at], None, 1), np.zeros(len(at), np.uint64)
        active = np.arange(len(at))
        for level in range(1, self.window + 1):
            grows = np.isin(prefix, self.long.get(level, np.empty(0, np.uint64))) if level < self.window and level in self.long else np.zeros(len(active), bool)
            group[active[~grows]] = prefix[~grows]
            active, prefix = active[grows], prefix[grows]
            if not len(active):
                break
            prefix = prefix_hash(codes[at[active] + level], prefix, level + 1)
        return (mix(group) % np.uint64(self.bins)).astype(np.int32)


def prefix_hash(code: np.ndarray, before: np.ndarray | None, level: int) -> np.ndarray:
    return mix(code * multipliers(1, 100 + level)[0] + (np.uint64(0) if before is None else before))


class Words:
    """Rows of a table, ordered by document, with their words' codes laid end to end."""

    def __init__(self, table: pa.Table, window: int, keep: bool = False):
        ids, texts = table.column("doc_id").to_pylist(), text_bytes(table.column("text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = np.array([ids[i] if ids[i] is not None else 0 for i in order], np.int64)
        self.known = np.array([ids[i] is not None for i in order], bool)
        self.th = table.column("th").to_numpy()[order]
        self.shard = table.column("shard").to_numpy()[order] if "shard" in table.column_names else None
        self.words, codes = [], []
        for i in order:
            words = (texts[i] or b"").split()
            codes.append(_codes.of(words))
            if keep:
                self.words.append(words)
        lengths = np.array([len(c) for c in codes], np.int64)
        self.lengths, self.first = lengths, np.cumsum(lengths) - lengths
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        self.row = np.repeat(np.arange(len(order)), lengths)
        # rows without an id take no part
        self.valid = within(lengths, window) & self.known[self.row[: max(0, len(self.codes) - window + 1)]]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """For sorted columns: where a new combination begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _count(batches: Iterator[pa.RecordBatch], window: int, share: float) -> Iterator[pa.RecordBatch]:
    """Counts of prefixes: of one word, and one word longer below each prefix with at least a quarter of ``share`` of
    a buffer's suffixes. A prefix with ``share`` of all suffixes is thus counted for three quarters of them at least."""
    for table in flushes(batches, BUFFER_BYTES):
        w = Words(table, window)
        at = np.flatnonzero(w.valid)
        prefix = prefix_hash(w.codes[at], None, 1)
        least = share / 4 * len(at)
        for level in range(1, window):
            values, inverse, n = np.unique(prefix, return_inverse=True, return_counts=True)
            heavy = n >= least
            if level == 1:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0]), pa.array([len(at)])], schema=_COUNTS)
            if not heavy.any():
                break
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(heavy.sum()), level), pa.int32()), pa.array(values[heavy].view(np.int64)), pa.array(n[heavy])], schema=_COUNTS)
            goes_on = heavy[inverse]
            at, prefix = at[goes_on], prefix[goes_on]
            prefix = prefix_hash(w.codes[at + level], prefix, level + 1)


def find_split(rows: DataFrame, window: int, size: int) -> Split:
    """Count prefixes in one pass and choose those to lengthen.

    A prefix is lengthened at ``1 / (4 * bins)`` of all suffixes, so the driver gets at most a few times as many
    prefixes as there are bins, for each length; bins follow the input (65,536 at most)."""
    bins = min(1 << 16, max(2 * shuffle_partitions(rows.sparkSession), size // 2 // GROUP_SUFFIXES))
    share = 1 / (4 * bins)
    counts = rows.mapInArrow(lambda b: _count(b, window, share), "level int, prefix long, n long")
    counts = materialise(counts.groupBy("level", "prefix").agg(F.sum("n").alias("n")))
    total = counts.filter("level = 0").agg(F.sum("n")).first()[0] or 0
    split = Split(window, bins)
    found = counts.filter(F.col("level") > 0).filter(F.col("n") >= max(1, 0.75 * share * total)).select("level", "prefix").collect()
    for level in range(1, window):
        if heavy := [p for n, p in found if n == level]:
            split.long[level] = np.sort(np.array(heavy, np.int64)).view(np.uint64)
    return split


def _send(batches: Iterator[pa.RecordBatch], split: Split) -> Iterator[pa.RecordBatch]:
    for table in flushes(batches, BUFFER_BYTES):
        w = Words(table, split.window)
        at = np.flatnonzero(w.valid)
        if not len(at):
            continue
        leaf, row = ngram_hashes(w.codes, split.window)[at], w.row[at]
        bin_of = split.bins_of(w.codes, w.valid)
        order = np.argsort(leaf, kind="stable")  # rows are in order of doc_id, so the first of a node is its smallest
        node = _heads(leaf[order])
        least = w.ids[row[order][node]][np.cumsum(node) - 1]
        settled, again = np.empty(len(at), bool), np.empty(len(at), bool)
        settled[order] = w.ids[row[order]] > least
        again[order] = ~_heads(leaf[order], row[order])
        yield from _settled(w, at, row, settled)
        # of each row in each bin: which of its different leaves, in order of place, are sent
        use = np.flatnonzero(~again)
        use = use[np.argsort(bin_of[use], kind="stable")]
        sent = ~settled[use]
        cut = np.flatnonzero(_heads(bin_of[use]))
        bins, blobs = [], []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(use)]):
            some = sent[s:e]
            if some.any():
                rows = row[use[s:e]]
                head = _heads(rows)
                mine, n = rows[head], np.diff(np.append(np.flatnonzero(head), len(rows)))
                bins.append(int(bin_of[use[s]]))
                blobs.append(pack(w.ids[mine], w.th[mine], w.shard[mine].astype(np.uint32), _narrow(n), np.packbits(some), leaf[use[s:e][some]]))
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(blobs, pa.binary())], schema=_LEAVES)


def _settled(w: Words, at: np.ndarray, row: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Leaves that the task found repeated: runs of places, by row. They need no bin, and are told by a negative one."""
    at, row = at[settled], row[settled]
    if not len(at):
        return
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    start = np.flatnonzero(head)
    rows, place, n = row[start], (at - w.first[row])[start], np.diff(np.append(start, len(at)))
    by_shard = np.argsort(w.shard[rows], kind="stable")
    rows, place, n = rows[by_shard], place[by_shard], n[by_shard]
    shards, cut = np.unique(w.shard[rows], return_index=True)
    blobs = [pack(w.th[rows[s:e]], w.ids[rows[s:e]], _narrow(place[s:e]), _narrow(n[s:e])) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)])]
    yield pa.RecordBatch.from_arrays([pa.array(-1 - shards, pa.int32()), pa.array(blobs, pa.binary())], schema=_LEAVES)


def _subtree(group: pa.Table) -> pa.Table:
    """Of a group's leaves, those under a node that also has a leaf in a document with a smaller id."""
    bins = group.column("bin").to_numpy()
    if len(bins) == 0 or bins[0] < 0:
        return pa.table({"shard": pa.array(-1 - bins, pa.int32()), "found": group.column("leaves").combine_chunks() if len(bins) else pa.array([], pa.binary())}, schema=_FOUND)
    ids, th, shard, ordinal, leaf = [], [], [], [], []
    for blob in group.column("leaves").to_pylist():
        doc, text, home, n, bits, hashes = unpack(blob)
        n = n.astype(np.int64)
        sent = np.unpackbits(bits, count=int(n.sum())).astype(bool)
        owner = np.repeat(np.arange(len(doc)), n)[sent]
        ids.append(doc.view(np.int64)[owner])
        th.append(text[owner])
        shard.append(home[owner])
        ordinal.append((np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))[sent].astype(np.uint32))
        leaf.append(hashes)
    ids, th, shard, ordinal, leaf = (np.concatenate(x) for x in (ids, th, shard, ordinal, leaf))
    order = np.argsort(leaf, kind="stable")
    node = np.flatnonzero(_heads(leaf[order]))
    least = np.repeat(np.minimum.reduceat(ids[order], node), np.diff(np.append(node, len(order))))
    hit = order[ids[order] > least]
    hit = hit[np.lexsort((ordinal[hit], ids[hit], th[hit], shard[hit]))]
    ids, th, shard, ordinal = ids[hit], th[hit], shard[hit], ordinal[hit]
    shards, cut = np.unique(shard, return_index=True)
    blobs = []
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)]):
        head = _heads(th[s:e], ids[s:e])
        n = np.diff(np.append(np.flatnonzero(head), e - s))
        blobs.append(pack(th[s:e][head], ids[s:e][head], _narrow(n), _narrow(ordinal[s:e]), np.array([bins[0]], np.uint32)))
    return pa.table({"shard": pa.array(shards.astype(np.int32)), "found": pa.array(blobs, pa.binary())}, schema=_FOUND)


def _repeats(texts: pa.Table, found: pa.Table, split: Split) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    """Each row of a shard with its words and whether each lies in a repeated window."""
    w = Words(texts, split.window, keep=True)
    place = {}
    for i, key in enumerate(zip(w.th.tolist(), w.ids.tolist(), w.known.tolist())):
        if key[2]:
            place.setdefault(key[:2], []).append(i)
    starts = np.zeros(len(w.codes) + 1, bool)
    by_bin: dict[int, list] = {}
    for blob in found.column("found").to_pylist():
        parts = unpack(blob)
        keys = list(zip(parts[0].view(np.int64).tolist(), parts[1].view(np.int64).tolist()))
        if len(parts) == 4:
            for key, s, n in zip(keys, parts[2].tolist(), parts[3].tolist()):
                for i in place[key]:
                    starts[w.first[i] + s : w.first[i] + s + n] = True
        else:
            by_bin.setdefault(int(parts[4][0]), []).append((keys, parts[2], parts[3]))
    if by_bin:
        _mark(w, split, place, by_bin, starts)
    repeated = np.cumsum(starts[:-1].astype(np.int64))
    before = np.concatenate([np.zeros(split.window, np.int64), repeated])[: len(repeated)]
    covered = repeated > before  # a window that begins at one of the last ``window`` words
    for i, words in enumerate(w.words):
        yield (int(w.ids[i]) if w.known[i] else None), words, covered[w.first[i] : w.first[i] + len(words)]


def _mark(w: Words, split: Split, place: dict, by_bin: dict, starts: np.ndarray) -> None:
    """Set the starts of the leaves that subtrees found, which are named by their number in a row's share of a bin."""
    at = np.flatnonzero(w.valid)
    leaf, row, bin_of = ngram_hashes(w.codes, split.window)[at], w.row[at], split.bins_of(w.codes, w.valid)
    order = np.lexsort((leaf, row))
    head = _heads(leaf[order], row[order])
    # stable order: the head of each run is the leaf's first place in the row
    first = np.zeros(len(at), bool)
    first[order[head]] = True
    same = np.empty(len(at), np.int64)  # the leaf's first place
    same[order] = order[head][np.cumsum(head) - 1]
    use = np.flatnonzero(first)
    use = use[np.lexsort((use, row[use], bin_of[use]))]
    begin = np.flatnonzero(_heads(bin_of[use], row[use]))
    share = {(int(b), int(r)): int(s) for b, r, s in zip(bin_of[use[begin]], row[use[begin]], begin)}
    hit = np.zeros(len(at), bool)
    for b, replies in by_bin.items():
        for keys, n, ordinal in replies:
            ends = np.cumsum(n.astype(np.int64))
            for key, e, k in zip(keys, ends.tolist(), n.tolist()):
                for i in place[key]:
                    hit[use[share[b, i] + ordinal[e - k : e].astype(np.int64)]] = True
    starts[at[hit[same]]] = True


def repeats(docs: DataFrame, window: int, result, schema: str) -> DataFrame:
    """Apply ``result(doc_id, words, covered)`` (a tuple of ``schema``) to each row of ``docs``.

    ``words`` are the row's words (bytes between ASCII white space) and ``covered`` says of each whether it lies in a
    run of ``window`` words that also starts in a row with a smaller ``doc_id``. Null and empty texts have no words.
    A row without id takes no part: nothing of it is covered and it covers nothing. Rows with the same id don't cover
    each other. An empty table gives no rows; columns other than ``doc_id`` and ``text`` are not looked at.
    """
    rows = row_key(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * shuffle_partitions(docs.sparkSession), size // SHARD_BYTES)
    rows = rows.withColumn("shard", F.pmod(F.hash("doc_id", "th"), F.lit(shards)).cast("int"))
    split = find_split(rows, window, size)
    leaves = rows.mapInArrow(lambda b: _send(b, split), "bin int, leaves binary")
    found = leaves.groupBy("bin").applyInArrow(_subtree, "shard int, found binary")
    kinds = arrow_schema(schema)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = [result(doc_id, words, covered) for doc_id, words, covered in _repeats(texts, found, split)]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(finish, schema)


def spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the maximal runs of covered words."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, begins, ends``: the longest runs of covered words of each row, as word numbers (see `repeats`)."""

    def of(doc_id, words, covered):
        begins, ends = spans(covered)
        return doc_id, len(words), begins.tolist(), ends.tolist()

    return repeats(docs, window, of, "doc_id long, n_words long, begins array<long>, ends array<long>")


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, text``: each row's words outside repeated passages, joined by one space (see `repeats`)."""

    def of(doc_id, words, covered):
        return doc_id, b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode()

    return repeats(docs, window, of, "doc_id long, text string")


def repeat_digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: the size and a digest of what `without_repeats` keeps."""

    def of(doc_id, words, covered):
        kept = [w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words
        return doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return repeats(docs, window, of, "doc_id long, n_words long, n_removed long, kept_sha256 string")

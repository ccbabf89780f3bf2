"""Near duplicates by SimHash, found with anchor points.

Two fingerprints of 64 bits that differ in at most ``t`` bits differ in at most ``t // 2`` bits of one of their halves.
The anchors of a half are the words of a covering code: the 31 low bits form a word of the Hamming code, which has
covering radius 1, and the top bit is free. Every fingerprint goes to all anchors within covering radius plus threshold,
so two fingerprints close in a half meet at the anchor nearest to either, and fingerprints are compared per anchor.
With ``t`` = 3 a fingerprint goes to at most 17 of 2^27 anchors for each half.

Only distinct fingerprints are placed at anchors, so copies cost nothing. An anchor with many fingerprints is searched
breadth first among those not reached yet: it reports a spanning tree of its links rather than all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, broadcast_if_below, emit, give_back, shuffle_partitions, text_bytes
from tidemark.session import in_parts, materialise

_SEED = 42
# Rows of one bin of anchors, which one task holds in memory.
_BIN_ROWS = 1 << 19
# Anchors with more fingerprints than this are searched breadth first.
_RUN = 24

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_PLACED = pa.schema([("bin", pa.int32()), ("anchor", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a text: bit ``i`` is set if it is set in over half of its shingles' hashes."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], _SEED) for s, e in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())], "<u8")
    set_bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Of the 31 low bits: the sum (exclusive or) of the numbers, from 1, of the set bits."""
    out = np.zeros(words.shape, np.uint32)
    for j in range(5):
        mask = np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1))
        out |= (np.bitwise_count(words & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(j)
    return out


def nearest_anchor(words: np.ndarray) -> np.ndarray:
    """The nearest code word of each 32-bit word: at most one bit differs."""
    s = _syndrome(words)
    flip = np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    return words ^ flip


def anchors_within(words: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit words, all anchors that are nearest to some word within ``threshold`` bits (these lie within
    the covering radius plus threshold): their places in ``words`` and the anchors."""
    near = words[:, None]
    masks = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(threshold):
        near = np.concatenate([near, (near[:, :, None] ^ masks).reshape(len(words), -1)], axis=1)
    anchors = np.sort(nearest_anchor(near), axis=1)
    new = np.ones(anchors.shape, bool)
    new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    return np.nonzero(new)[0], anchors[new]


def links_of_run(fps: np.ndarray, nodes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some fingerprints."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[at]) <= threshold
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), nodes[at]))
            b.append(nodes[found])
            queue.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links_of_bin(anchor: np.ndarray, fp: np.ndarray, node: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of a common anchor; ``node`` names the fingerprints."""
    order = np.argsort(anchor, kind="stable")
    anchor, fp, node = anchor[order], fp[order].view(np.uint64), node[order]  # bits of signed numbers aren't counted as such
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, int)
    size = np.diff(np.append(begin, len(anchor)))
    a, b = [], []
    for s, n in zip(begin[size > _RUN].tolist(), size[size > _RUN].tolist()):
        x, y = links_of_run(fp[s : s + n], node[s : s + n], threshold)
        a.append(x)
        b.append(y)
    short = np.repeat((size > 1) & (size <= _RUN), size)
    anchor, fp, node = anchor[short], fp[short], node[short]
    for step in range(1, min(_RUN, len(anchor))):
        hit = (anchor[step:] == anchor[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= threshold)
        a.append(node[:-step][hit])
        b.append(node[step:][hit])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint (as a signed long) of every row's whole text; null counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t, width) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], schema=_FINGERPRINTS)
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, fp long")


def links(nodes: DataFrame, threshold: int = 3) -> DataFrame:
    """``a, b``: links between fingerprints (``fp``, each with its ``node``) at most ``threshold`` bits apart.
    Every link is among these or follows from them by way of others."""
    if threshold > 5:
        raise ValueError("a half may differ in at most two bits, so the threshold is at most 5")
    spark = nodes.sparkSession
    bins = max(2 * shuffle_partitions(spark), nodes.count() * 34 // _BIN_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            for half in (0, 1):
                word = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                for part in range(0, len(word), 4096):
                    at, anchor = anchors_within(word[part : part + 4096], threshold // 2)
                    at, anchor = at + part, anchor.astype(np.int64) | half << 32
                    spread = (anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(bins)
                    yield emit({"bin": spread.astype(np.int32), "anchor": anchor, "fp": fp[at], "node": node[at]}, _PLACED)

    def compare(bin_of: pa.Table) -> pa.Table:
        a, b = links_of_bin(*(bin_of.column(c).to_numpy() for c in ("anchor", "fp", "node")), threshold)
        return pa.table([pa.array(a), pa.array(b)], schema=_LINKS)

    placed = nodes.select("fp", "node").mapInArrow(place, "bin int, anchor long, fp long, node long")
    return placed.groupBy("bin").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (``a, b``) reaches.

    Large-star and small-star steps alternate until nothing changes; each is a minimum by node and a join, and is
    written to the checkpoint folder, in as many parts as the edges need."""

    def star(of: DataFrame, large: bool, rows: int) -> DataFrame:
        pairs = of.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            pairs = pairs.union(of.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that both sides of the join are plain shuffles and a hub's rows can be split
        least = materialise(in_parts(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows))
        moved = pairs.join(least, "u")
        if large:
            out = moved.filter(F.col("v") > F.col("u")).select(F.col("m").alias("b"), F.col("v").alias("a"))
        else:
            out = moved.select(F.col("m").alias("b"), F.col("v").alias("a")).union(least.select(F.col("m").alias("b"), F.col("u").alias("a")))
        return out.filter("a <> b").select("a", "b").distinct()

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    rows, seen = edges.count(), None
    while True:
        edges = materialise(in_parts(star(star(edges, True, rows), False, rows), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rows = now[0]
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _classes(docs: DataFrame, threshold: int, width: int) -> tuple[DataFrame, DataFrame, int]:
    """``doc_id, fp`` of each row; ``fp, component_id`` of each fingerprint; the number of rows."""
    rows = materialise(fingerprints(docs, width))
    n = rows.count()
    nodes = materialise(in_parts(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), n))
    roots = components(materialise(in_parts(links(nodes, threshold), n)))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows, named, n


def near_duplicates(docs: DataFrame, threshold: int = 3, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: the fingerprint of each row and the smallest ``doc_id`` it reaches over links.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. Null and empty texts have fingerprint zero
    and link with one another. Rows that repeat are returned as often as they come. A row without ``doc_id`` is
    returned; its id counts for nothing, and its component is that of its fingerprint (null if no such row has an id).
    An empty table gives no rows.
    """
    rows, named, _ = _classes(docs, threshold, width)
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, threshold: int = 3, width: int = 3) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest ``doc_id``. Rows without id stay;
    rows of one id that stays all stay, since they are one document."""
    rows, named, n = _classes(docs, threshold, width)
    found = rows.join(named, "fp").filter(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    away = materialise(in_parts(found, n))
    return docs.join(broadcast_if_below(away, away.count(), 64), "doc_id", "left_anti").select(*docs.columns)

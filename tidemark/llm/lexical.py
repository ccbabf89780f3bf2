"""Ranked lexical search, a term at a time, with a limit on accumulators.

The corpus is cut into blocks of documents. In a block an item's terms are taken from the rarest to the commonest. A
document gets an accumulator when a term meets it first; the term's share of the score is added to the accumulators it
meets. Once what the remaining terms can add at most is less than the k-th partial score, no other document can come
among the first k, so no more accumulators are made and the rest of the terms, the common ones, only update those there
are, exactly. A task carries each item's k best documents from block to block, and its k-th score is a bound for the next.

Documents are read once for the postings of the items' terms, from which the counts for the weights follow; the postings
are written to the shared folder and searched from there. Items are taken in slices of a bounded number of terms, each a
pass over the documents; a slice's terms are what is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, arrays_of, arrow_schema, emit, flushes, stash, text_bytes

#: What terms are made of: all but these characters (fixed values).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM.encode())

# Pairs of item and term in a slice, on average at most.
SLICE_TERMS = 1 << 18
# Text counted together, and postings searched together.
_TEXT_BYTES, _BLOCK_BYTES = 4 << 20, 16 << 20
_POSTINGS = "doc_id long, n long, terms array<long>, counts array<long>"


class _Vocabulary(dict):
    """Numbers of terms; -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id, ih, term``: each item's different terms. Items are told apart by id and text (``ih`` is its hash)."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select("item_id", F.xxhash64(F.col("text").cast("string")).alias("ih"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    return terms.select("item_id", "ih", F.explode(F.array_distinct("terms")).alias("term")).distinct()


def _postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: for every row with a term the number of its terms, and those of the vocabulary (by number)
    with how often they come."""
    known, schema = docs.sparkSession.sparkContext.broadcast(vocabulary), arrow_schema(_POSTINGS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Vocabulary((t, i) for i, t in enumerate(known.value))
        for table in flushes(batches, _TEXT_BYTES):
            words = [_TERM.findall(t.translate(LOWER)) if t else [] for t in text_bytes(table.column("text").combine_chunks())]
            lengths = np.array([len(w) for w in words], np.int64)
            codes = np.fromiter((c for w in words for c in map(numbers.__getitem__, w)), np.int64, int(lengths.sum()))
            key = np.repeat(np.arange(len(words)), lengths) * max(1, len(numbers)) + codes
            key, counts = np.unique(key[codes >= 0], return_counts=True)
            sizes = np.bincount(key // max(1, len(numbers)), minlength=len(words))
            rows = np.flatnonzero(lengths)
            yield emit(
                {
                    "doc_id": table.column("doc_id").combine_chunks().take(pa.array(rows)), "n": lengths[rows],
                    "terms": arrays_of([key % max(1, len(numbers))], sizes[rows].tolist(), pa.int64()),
                    "counts": arrays_of([counts], sizes[rows].tolist(), pa.int64()),
                },
                schema,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, _POSTINGS)


def _first(score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, equal scores by id (none first)."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], -k)[-k]]
    return at[np.lexsort((doc[at], ~null[at], -score[at]))][:k]


class Block:
    """The inverted postings of some documents, with each posting's share of the score."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int):
        m = 50 + 50 * n * documents // total
        owner = np.repeat(np.arange(len(n)), sizes)
        share = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[owner]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.share = owner[order], share[order]
        self.terms, begin = np.unique(terms[order], return_index=True)
        self.cut = np.append(begin, len(order))
        self.most = np.maximum.reduceat(self.share, begin) if len(begin) else np.empty(0, np.int64)
        self.accumulators = np.zeros(len(n), np.int64)
        self.alive = np.zeros(len(n), bool)

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the block) and scores for an item's ``terms``, rarest first: all that are among the ``k`` best
        and not below ``floor``, and some others."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        left = np.cumsum(self.most[at][::-1])[::-1].tolist()
        score, alive = self.accumulators, self.alive
        survivors = None
        for i, t in enumerate(at.tolist()):
            docs, share = self.docs[self.cut[t] : self.cut[t + 1]], self.share[self.cut[t] : self.cut[t + 1]]
            if survivors is None and left[i] < floor:
                survivors = np.flatnonzero(alive)
            if survivors is None:
                score[docs] += share
                alive[docs] = True
                made = score[alive]
                if len(made) >= k:
                    floor = max(floor, int(np.partition(made, -k)[-k]))
            elif len(docs) > 8 * len(survivors):
                place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                met = docs[place] == survivors
                score[survivors[met]] += share[place[met]]
            else:
                met = alive[docs]
                score[docs[met]] += share[met]
        docs = np.flatnonzero(alive) if survivors is None else survivors
        found = score[docs]
        score[docs], alive[docs] = 0, False
        return docs, found


def _searched(postings: DataFrame, ids: pa.Array, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: each task's ``k`` best documents of every item."""
    schema = pa.schema([("item", pa.int64()), ("item_id", ids.type), ("doc_id", pa.int64()), ("score", pa.int64())])
    sent = postings.sparkSession.sparkContext.broadcast((ids, queries, weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, weights = sent.value
        nothing = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        best = [nothing] * len(queries)
        for table in flushes(batches, _BLOCK_BYTES):
            lists = {c: table.column(c).combine_chunks() for c in ("terms", "counts")}
            sizes = np.diff(lists["terms"].offsets.to_numpy())
            flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
            doc = table.column("doc_id").combine_chunks()
            null, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False)
            block = Block(table.column("n").to_numpy(), sizes, flat["terms"], flat["counts"], weights, documents, total)
            for i, terms in enumerate(queries):
                floor = int(best[i][0][-1]) if len(best[i][0]) == k else 1
                docs, score = block.search(terms, k, floor)
                if len(docs):
                    together = tuple(np.concatenate(x) for x in zip(best[i], (score, null[docs], doc[docs])))
                    chosen = _first(*together, k)
                    best[i] = tuple(x[chosen] for x in together)
        item = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
        if len(item):
            score, null, doc = (np.concatenate(x) for x in zip(*best))
            yield emit({"item": item, "item_id": ids.take(pa.array(item)), "doc_id": pa.array(doc, mask=null), "score": score}, schema)

    kind = {f.name: f.dataType.simpleString() for f in _spark_fields(schema)}
    return postings.mapInArrow(of, ", ".join(f"{name} {of_type}" for name, of_type in kind.items()))


def _spark_fields(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema).fields


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents with the highest scores above 0 (all, if fewer),
    equal scores by ascending ``doc_id`` (documents without id first).

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document's score sums ``weight * (10^9 tf div (1000 tf +
    20 m))`` over the item's different terms, with ``m`` 50 parts in 100 of fixed length and 50 of the document's length by the
    mean. Counts are over all rows of ``docs`` with a term, so rows that repeat count and are ranked as often as they come.
    Items that repeat (same id and text) are searched once; an item without a term, or whose terms no document has, has no
    rows; an empty table on either side gives an empty result. Null and empty texts have no terms; texts of any length are
    counted whole. Columns other than ``doc_id`` and ``text``, ``item_id`` and ``text`` are not looked at.
    """
    if k < 1:
        raise ValueError("at least one document has to be asked for")
    pairs = stash(_item_terms(items))
    slices = max(1, -(-pairs.count() // SLICE_TERMS))
    pairs = pairs.withColumn("_slice", F.pmod(F.xxhash64("item_id", "ih"), F.lit(slices)))
    results = [r for s in range(slices) if (r := _slice(docs, pairs.filter(F.col("_slice") == s), k)) is not None]
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionAll, [r.withColumn("_slice", F.lit(i)) for i, r in enumerate(results)])
    order = Window.partitionBy("_slice", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _slice(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame | None:
    """The best documents for a slice of items, some for each task."""
    numbered = pairs.select("item_id", "ih", "term").toArrow().sort_by([("ih", "ascending"), ("item_id", "ascending"), ("term", "ascending")])
    if not numbered.num_rows:
        return None
    names, term = np.unique(np.array([t.encode() for t in numbered["term"].to_pylist()], object), return_inverse=True)
    postings = stash(_postings(docs, names.tolist()))
    stats = postings.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    if not stats.documents:
        return None
    df = np.zeros(len(names), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row[0]] = row[1]
    weights = np.array([math.floor(1000 * math.log((2 * stats.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    ids = numbered["item_id"].combine_chunks()
    item = np.concatenate([[0], np.cumsum([a != b for a, b in zip(*(list(zip(numbered["ih"].to_pylist(), ids.to_pylist()))[s] for s in (slice(1, None), slice(None, -1))))])])
    begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    queries = [t[np.lexsort((t, df[t]))] for t in (t[weights[t] > 0] for t in np.split(term, begin[1:]))]
    return _searched(postings, ids.take(pa.array(begin)), queries, weights, stats.documents, stats.total, k)

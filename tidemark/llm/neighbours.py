"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of their centred principal components after rotations that are learned (iterative
quantisation) on a bounded sample. A code is split into substrings, each with an index of its own. If two codes differ in
at most ``radius`` bits, they differ in at most ``radius // substrings`` bits of one substring (the pigeonhole
principle), so probing each index that far retrieves every code within the radius; what is retrieved is ranked by inner
products of the original vectors. The radius is the one within which a stated share of true neighbours lies, measured by
brute force for a bounded sample of the queries against all rows.

An index is dealt out by the first bits of its substring, and a query goes to those parts its probes can reach. Parts
are counted first: the vectors of one too large for a task are dealt to several by a hash, and its queries go to each.
Every part ranks what it retrieves and reports each query's nearest, so no pairs are shuffled. Equal vectors are searched,
and stand as candidates, once.

Inner products are made angles by one more component, which gives all rows the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, shuffle_partitions
from tidemark.session import materialise

ROTATIONS = 2
SUBSTRING = 32  # bits at most
# Components with a smaller share of the largest variance are noise (the lengths of rounded unit vectors, say).
_LEAST_VARIANCE = 1e-5
SAMPLE_NUMBERS = 1 << 21  # of the sample that the rotations are learned from
SAMPLE_QUERIES = 200
AIM = 0.97
# Bytes of the vectors in one part of an index (or one share of a part), which one task holds, and queries that it answers.
_PART_BYTES = 1 << 25
_PART_QUERIES = 1 << 11
_SPREAD_ROWS = 1 << 14  # of one batch on the way to parts

_FOUND = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("score", pa.float64()), ("first_id", pa.int64())])


@dataclass
class Coder:
    """Turns vectors into codes: a 32-bit word for each substring, which holds real bits only."""

    mean: np.ndarray
    axes: np.ndarray
    longest: float

    def _bits(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        y = (np.concatenate([x, extra[:, None]], axis=1) - self.mean) @ self.axes
        bits = np.zeros((len(x), self.substrings, 32), np.uint8)
        at = 0
        for t, width in enumerate(self.widths):
            bits[:, t, :width] = y[:, at : at + width] > 0
            at += width
        return np.packbits(bits.reshape(len(x), 32 * self.substrings), axis=1, bitorder="little").view("<u4")

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._bits(x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(1))))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(x, np.zeros(len(x)))

    @property
    def substrings(self) -> int:
        return -(-self.axes.shape[1] // SUBSTRING)

    @property
    def widths(self) -> list[int]:
        """The bits of each substring: equally many, or one more."""
        least, more = divmod(self.axes.shape[1], self.substrings)
        return [least + (t < more) for t in range(self.substrings)]


def learn_coder(sample: np.ndarray, longest: float, rotations: int = ROTATIONS, steps: int = 25, seed: int = 5) -> Coder:
    x = np.concatenate([sample, np.sqrt(np.maximum(0, longest**2 - (sample * sample).sum(1)))[:, None]], axis=1)
    mean = x.mean(0)
    values, components = np.linalg.eigh(np.cov((x - mean).T))
    components = components[:, values > values.max() * _LEAST_VARIANCE]
    y, random, axes = (x - mean) @ components, np.random.default_rng(seed), []
    for _ in range(rotations):
        turn = np.linalg.qr(random.standard_normal((y.shape[1], y.shape[1])))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.sign(y @ turn).T @ y)
            turn = (u @ v).T
        axes.append(components @ turn)
    return Coder(mean, np.concatenate(axes, axis=1), longest)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order for every row, so that equal vectors have equal products."""
    return (vectors * query).sum(1)


def _best(scores: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((first_id[near], -scores[near]))][:k]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: rows with an id and a vector that is not zero and holds only finite numbers, of the commonest
    length (of equally common ones the smallest). A row that repeats with the same vector counts once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(
        "vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(x, v -> v <> 0)")
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (lengths["n"] if lengths else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, aim: float = AIM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that the condition ``is_query`` names.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not looked at. Nearness is the inner product in
    double precision, ties go to the smaller ``vec_id``; a query's own id is no candidate. Which rows take part is told
    in `usable`. A query that retrieves fewer than ``k`` rows is searched again without a radius, so that a query gets fewer
    only if there are fewer; tables without queries or with one row give no rows.
    ``aim`` is the share of true neighbours that the radius is chosen for.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), F.col("x"))})
    asks = rows.filter(is_query).select("vec_id", "h1", "h2").distinct()
    # of equal vectors only the k + 1 smallest ids can be among the nearest of any query
    by_vector = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    distinct = few.groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x"))
    distinct = materialise(distinct.join(asks.select("h1", "h2", F.lit(True).alias("asks")).distinct(), ["h1", "h2"], "left"))
    facts = distinct.agg(F.count("*").alias("n"), F.count("asks").alias("asks"), F.max(F.size("x")).alias("dim"), F.max(F.expr("aggregate(x, 0D, (a, v) -> a + v * v)")).alias("longest")).first()
    if not facts["asks"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, longest = facts["dim"], float(np.sqrt(facts["longest"]))
    some = distinct.orderBy(F.xxhash64("first_id"), "first_id")
    sample = np.array([r["x"] for r in some.limit(max(64, SAMPLE_NUMBERS // dim)).select("x").collect()])
    coder = learn_coder(sample, longest) if len(sample) > 1 and np.ptp(sample, axis=0).any() else Coder(np.zeros(dim + 1), np.eye(dim + 1), longest)
    radius = _radius(distinct, some.filter("asks").limit(SAMPLE_QUERIES), coder, dim, k, aim)
    found = materialise(_search(distinct, coder, dim, radius, k + 1, facts["n"]))
    enough = found.groupBy("q").count().filter(F.col("count") >= min(k + 1, facts["n"])).select(F.col("q").alias("first_id"))
    rest = materialise(distinct.filter("asks").join(enough, "first_id", "left_anti").select("first_id", F.lit(True).alias("asks")))
    if rest.count():  # with too few rows within the radius: search all
        again = distinct.drop("asks").join(rest, "first_id", "left")
        found = found.join(rest.select(F.col("first_id").alias("q")), "q", "left_anti").unionByName(
            _search(again, coder, dim, coder.substrings * SUBSTRING, k + 1, facts["n"]))

    best = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    ids = distinct.select(F.col("first_id").alias("v"), "ids")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).join(ids, "v")
    lists = top.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("top"))  # k + 1 vectors at most
    lists = lists.select("q", F.expr(
        f"slice(array_sort(flatten(transform(top, t -> transform(t.ids, i -> struct(-t.score AS s, i AS id))))), 1, {k + 1})").alias("top"))
    keyed = lists.join(distinct.select(F.col("first_id").alias("q"), "h1", "h2"), "q").select("h1", "h2", "top")
    own = F.expr(f"slice(filter(top, t -> t.id <> vec_id), 1, {k})")
    return asks.join(keyed, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "t")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def _radius(distinct: DataFrame, queries: DataFrame, coder: Coder, dim: int, k: int, aim: float) -> int:
    """The number of differing bits within which ``aim`` of the sample queries' true neighbours lie."""
    sample = queries.select("first_id", "x").collect()  # SAMPLE_QUERIES rows at most
    asked, x = np.array([r["first_id"] for r in sample], np.int64), np.array([r["x"] for r in sample])
    codes = coder.of_queries(x)
    schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("bits", pa.int32())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, first = _vectors(batch.column("x"), dim), batch.column("first_id").to_numpy()
            rows = coder.of_rows(v)
            for q, y, code in zip(asked.tolist(), x, codes):
                score = np.where(first == q, -np.inf, v @ y)
                at = _best(score, first, k)
                bits = np.bitwise_count(rows[at] ^ code).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(score[at]), pa.array(bits.astype(np.int32))], schema=schema)

    found = distinct.select("first_id", "x").mapInArrow(of, "q long, score double, bits int").filter("score > double('-Infinity')")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k)
    bits = [r["bits"] for r in best.select("bits").collect()]  # k rows for each sample query
    return int(np.ceil(np.quantile(bits, aim))) if bits else 0


def _search(distinct: DataFrame, coder: Coder, dim: int, radius: int, k: int, n: int) -> DataFrame:
    """``q, v, score, first_id``: for each query its nearest vectors in each part of each index."""
    reach = radius // coder.substrings
    prefix, most = 0, max(1, _PART_BYTES // (8 * dim))  # rows
    while n >> prefix > most and prefix < min(16, *coder.widths):
        prefix += 1
    parts = np.arange(1 << prefix, dtype=np.uint32)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """For each index, of vectors and then of queries: rows of the batch and the parts they go to."""
        x, asks = _vectors(batch.column("x"), dim), np.array(batch.column("asks").to_pylist(), object) == True  # noqa: E712
        at = np.flatnonzero(asks)
        rows, queries = coder.of_rows(x), coder.of_queries(x[at])
        for t in range(coder.substrings):
            yield t, False, np.arange(len(x)), (rows[:, t] & parts[-1]).astype(np.int64)
            row, part = np.nonzero(np.bitwise_count((queries[:, t] & parts[-1])[:, None] ^ parts[None, :]) <= reach)
            yield t, True, at[row], part

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((coder.substrings, 2, len(parts)), np.int64)
        for batch in batches:
            if batch.num_rows:
                for t, query, _, part in places(batch):
                    sizes[t, int(query)] += np.bincount(part, minlength=len(parts))
        t, query, part = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(query), pa.array(part), pa.array(sizes[t, query, part])], ["t", "query", "part", "n"])

    wide = distinct.select("first_id", "asks", "x").repartition(shuffle_partitions(distinct.sparkSession))
    sizes = np.zeros((coder.substrings, 2, len(parts)), np.int64)
    counted = wide.mapInArrow(count, "t long, query long, part long, n long").groupBy("t", "query", "part").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # two numbers for each part of an index at most
        sizes[r["t"], r["query"], r["part"]] = r["n"]
    shares, slices = -(-sizes[:, 0] // most), -(-sizes[:, 1] // _PART_QUERIES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its part of every index, once for each slice of the queries that reach it; each query in all
        parts it reaches, once for each share of their vectors."""
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("first_id").to_numpy()
            dealt = mix(first.view(np.uint64)) >> np.uint64(1)
            for t, query, row, part in places(batch):
                own, other = (slices, shares) if query else (shares, slices)
                mine, copies = (dealt[row] % own[t, part].astype(np.uint64)).astype(np.int64), other[t, part]
                total = int(copies.sum())
                if not total:
                    continue
                each = np.arange(total) - np.repeat(np.cumsum(copies) - copies, copies)
                row, part, mine = (np.repeat(c, copies) for c in (row, part, mine))
                share, piece = (each, mine) if query else (mine, each)
                for s in range(0, total, _SPREAD_ROWS):
                    cut = slice(s, s + _SPREAD_ROWS)
                    yield pa.RecordBatch.from_arrays([
                        *[pa.array(c[cut].astype(np.int32)) for c in (np.full(total, t), part, share, piece)],
                        pa.array(np.full(len(row[cut]), query)), batch.column("first_id").take(pa.array(row[cut])), batch.column("x").take(pa.array(row[cut]))],
                        ["t", "part", "share", "piece", "query", "id", "x"])

    def probe(part: pa.Table) -> pa.Table:
        t = part.column("t")[0].as_py()
        query = np.array(part.column("query").to_pylist())
        x, ids = _vectors(part.column("x"), dim), part.column("id").to_numpy()
        v, v_id, q, q_id = x[~query], ids[~query], x[query], ids[query]
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(v) and len(q):
            v_code, q_code = coder.of_rows(v), coder.of_queries(q)
            buckets, bucket_of = np.unique(v_code[:, t], return_inverse=True)
            for i in range(len(q)):
                reached = np.bitwise_count(buckets ^ q_code[i, t]) <= reach
                at = np.flatnonzero(reached[bucket_of])
                bits = np.bitwise_count(v_code[at] ^ q_code[i])
                # within the radius, and not retrieved from an earlier index already
                at = at[(bits.sum(1) <= radius) & ~(bits[:, :t] <= reach).any(1)]
                score = _products(v[at], q[i])
                best = _best(score, v_id[at], k)
                for column, values in zip(out, (np.full(len(best), q_id[i]), v_id[at[best]], score[best])):
                    column.append(values)
        a, b, s = (np.concatenate(c) for c in out)
        return pa.table([pa.array(a), pa.array(b), pa.array(s), pa.array(b)], schema=_FOUND)

    return (
        wide.mapInArrow(spread, "t int, part int, share int, piece int, query boolean, id long, x array<double>")
        .groupBy("t", "part", "share", "piece").applyInArrow(probe, "q long, v long, score double, first_id long")
    )

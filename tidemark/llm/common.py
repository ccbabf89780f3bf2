"""Helpers of the corpus operators: word splitting on bytes, word codes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: Lower-cases A-Z only, other bytes stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

# A worker remembers this many word codes, so that its memory stays bounded.
_MOST_CODES = 1 << 18

# A derived table is hinted for broadcast only when it was counted and is below this many bytes.
BROADCAST_BYTES = 16 << 20


class Codes(dict):
    """64-bit codes (XXH64) of words, remembered while there are at most ``_MOST_CODES``."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(self) < _MOST_CODES:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ngram_hashes(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``n`` neighbouring codes (``len(codes) - n + 1`` of them)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k, factor in enumerate(multipliers(n, seed + n)):
        total += codes[k : k + size] * factor
    return mix(total)


def within(lengths: np.ndarray, n: int) -> np.ndarray:
    """For texts of so many words, laid end to end: does a run of ``n`` words from here stay in its text?
    One flag for each possible start, ``sum(lengths) - n + 1`` of them."""
    total = int(lengths.sum())
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)
    return left[: total - n + 1] >= n


def row_key(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` with, as ``th``, a hash of the text: together they name a row's content."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("th"), *columns,
    )


def same_row(left: DataFrame, right: DataFrame) -> object:
    """Join condition on ``doc_id`` and ``th``, in which no id equals no id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the written columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_below(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if ``rows`` counted rows of ``row_bytes`` each stay below ``BROADCAST_BYTES``; else leave
    the join to the planner, which shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold but don't use. Workers live on from stage to stage, and
    else each keeps what its largest piece of work has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def emit(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def arrays_of(parts: list, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """A list column from numpy pieces laid end to end."""
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, kind))


def flushes(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Join and cut Arrow batches to tables of about ``most_bytes`` (one row may be larger), so that a table is worth
    its fixed cost and fits in memory."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: The Arrow types of the column types that results use.
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
          "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(ddl: str) -> pa.Schema:
    """``name type, ...`` as an Arrow schema."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(","))])

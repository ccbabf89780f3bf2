"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space, and every run of one to three characters that begins and
ends a text's letters or spaces is hashed to one of ``BUCKETS``. Counts by language and bucket are summed by Spark; the
matrix of their logarithms, languages by buckets, goes to every task and whole batches of texts are scored by gathering
from it. With more languages than one matrix holds, the matrix is sent and the texts are scored slice by slice, and each
text carries its best language so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import emit, flushes, stash

BUCKETS = 1 << 14
# Numbers of a matrix, at most: it is sent to all tasks. More languages take more matrices, one after another.
MOST_CELLS = 1 << 22
BUFFER_BYTES = 4 << 20
ALPHA = 0.1

_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
_SPACE = 32
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _lower(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, a space for each that is no letter, with a space before and after."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[points], points, np.uint32(_SPACE))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, text by text, and how many each text has (none without a letter)."""
    all_buckets, sizes = [], []
    points = [_lower(t) for t in texts]
    with np.errstate(over="ignore"):
        for p in points:
            letter = p != _SPACE
            if not letter.any():
                sizes.append(0)
                continue
            x = p.astype(np.uint32)
            two = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) ^ x[2:] * np.uint32(0x27D4EB2F)
            one = x[letter] * np.uint32(0x165667B1)
            # runs of spaces alone tell nothing
            two, three = two[letter[:-1] | letter[1:]], three[letter[:-2] | letter[1:-1] | letter[2:]]
            buckets = np.concatenate([one, two + np.uint32(1), three + np.uint32(2)])
            buckets ^= buckets >> np.uint32(15)
            all_buckets.append((buckets * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int32))
            sizes.append(len(buckets))
    return (np.concatenate(all_buckets) if all_buckets else np.empty(0, np.int32)), np.array(sizes, np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n``: how often each bucket comes in the texts of each language. Rows without either are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for table in flushes(batches, BUFFER_BYTES):
            buckets, sizes = grams(table.column("text").to_pylist())
            named = table.column("lang").combine_chunks().dictionary_encode()
            codes = named.dictionary
            cell = np.repeat(named.indices.to_numpy().astype(np.int64), sizes) * BUCKETS + buckets
            if len(codes) * BUCKETS > MOST_CELLS:
                some, n = np.unique(cell, return_counts=True)
                yield emit({"lang": codes.take(pa.array(some // BUCKETS)), "bucket": (some % BUCKETS).astype(np.int32), "n": n.astype(np.int64)}, _COUNTS)
                continue
            flat = np.bincount(cell, minlength=len(codes) * BUCKETS)
            for i, lang in enumerate(codes.to_pylist()):
                held[lang] = held.get(lang, 0) + flat[i * BUCKETS : (i + 1) * BUCKETS]
            if len(held) * BUCKETS > MOST_CELLS:
                yield from _counted(held)
                held = {}
        yield from _counted(held)

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(of, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _counted(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, n in held.items():
        some = np.flatnonzero(n)
        yield emit({"lang": [lang] * len(some), "bucket": some.astype(np.int32), "n": n[some].astype(np.int64)}, _COUNTS)


class Model:
    """Languages in order, the logarithm of their share of texts' n-grams in each bucket, and of their prior."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        smooth = table + ALPHA
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)) if len(langs) else smooth

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its logarithm, and the likelihood of all languages as a multiple of its own;
        ``und`` and nothing (of a multiple 0) for texts without a letter."""
        buckets, sizes = grams(texts)
        some = np.flatnonzero(sizes)
        out, top, mass = np.full(len(texts), "und", object), np.full(len(texts), -np.inf), np.zeros(len(texts))
        if len(some) and self.langs:
            begin = (np.cumsum(sizes) - sizes)[some]
            total = np.stack([np.add.reduceat(row[buckets], begin) for row in self.log])
            out[some] = np.array(self.langs, object)[total.argmax(0)]
            top[some] = total.max(0)
            mass[some] = np.exp(total - total.max(0)).sum(0)
        return out.tolist(), top, mass


def learn(docs: DataFrame, languages: int | None = None) -> Iterator[Model]:
    """The models of the languages that ``docs`` (``lang, text``) names, in the order of their names, with so many languages
    each (``MOST_CELLS`` numbers by default). All languages have the same prior. What the driver holds at a time is one
    model; the counts are a table in the shared folder."""
    languages = languages or MOST_CELLS // BUCKETS
    named = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang")).distinct()
    # one row a language, of BUCKETS entries at most
    sums = counts(docs).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    table = stash(named.join(sums, "lang", "left"))
    rest = table
    while langs := [r["lang"] for r in rest.select("lang").orderBy("lang").limit(languages).collect()]:
        matrix, at = np.zeros((len(langs), BUCKETS)), {lang: i for i, lang in enumerate(langs)}
        found = table.filter(F.col("lang").between(langs[0], langs[-1])).filter("n IS NOT NULL").toArrow()
        for lang, bucket, n in zip(found.column("lang").to_pylist(), *(found.column(c) for c in ("bucket", "n"))):
            matrix[at[lang], bucket.values.to_numpy()] = n.values.to_numpy()
        yield Model(langs, matrix)
        if len(langs) < languages:
            return
        rest = table.filter(F.col("lang") > langs[-1])


def _scored(rows: DataFrame, model: Model, keep: bool) -> DataFrame:
    """``rows`` (``doc_id, text, held_out, lang, top, mass``) with the best language so far and those of ``model``; the texts are
    null from here on unless ``keep``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_()), ("lang", pa.string()), ("top", pa.float64()), ("mass", pa.float64())])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flushes(batches, BUFFER_BYTES):
            doc, text, out, before = (table.column(c).combine_chunks() for c in ("doc_id", "text", "held_out", "lang"))
            lang, top, mass = shared.value.score(text.to_pylist())
            old_top, old_mass = (table.column(c).to_numpy() for c in ("top", "mass"))
            better, best = top > old_top, np.maximum(top, old_top)
            with np.errstate(invalid="ignore"):  # without a letter both are minus infinity and weigh nothing
                mass = np.where(mass > 0, mass * np.exp(top - best), 0) + np.where(old_mass > 0, old_mass * np.exp(old_top - best), 0)
            lang = [new if b else old for new, b, old in zip(lang, better.tolist(), before.to_pylist())]
            yield emit({"doc_id": doc, "text": text if keep else pa.nulls(len(text), pa.string()), "held_out": out, "lang": lang, "top": best, "mass": mass}, schema)

    return rows.mapInArrow(of, "doc_id long, text string, held_out boolean, lang string, top double, mass double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, languages: int | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Rows whose ``crc32(doc_id) mod folds`` is ``held`` are held out, and the model learns from the others that have a
    text and a language. ``score`` is the probability of the predicted language. A text that is null or has no letter
    is ``und`` with score 0; so is every text if there is nothing to learn from. Of equally likely languages the first
    by name is taken. There may be any number of languages: every ``languages`` of them are one pass over the texts. An
    empty table gives no rows.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are not looked at. A row without id is learned from and
    predicted. Rows come back as often as they come.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"))
    scored = rows.select("doc_id", "text", "held_out", F.lit("und").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"))
    models = learn(rows.filter("NOT held_out"), languages)
    model, first = next(models, None), True
    while model:
        following = next(models, None)
        scored = _scored(scored if first else stash(scored), model, following is not None)
        model, first = following, False
    return scored.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0).alias("score"))

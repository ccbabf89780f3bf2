"""Mixture-controlled packing by deficit round-robin.

The documents of a source, one after another, are its queue, and a queue is served in chunks of ``chunk`` tokens. In each
round, which is one window long, every queue's deficit grows by its share of the window; the queue is served as many
chunks as its deficit covers and carries the rest over. What has been served after a round follows from the round's number
and a queue's length alone, so the place of any chunk in the output is computed from the queues' totals: no task walks the
queues, and deficits carry across windows and tasks exactly as in one long walk.

With so many queues that the totals would not fit in every task, the same places are the running sum of all chunks in the order
of their rounds and queues, and are joined to the documents.

A queue's order needs the tokens before each document. Documents are dealt to blocks of their queue, so a hot source is
spread over many tasks; blocks are summed first and documents only within their block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import LOWER, give_back, shuffle_partitions, stash, text_bytes
from tidemark.operators.running import Running, running
from tidemark.session import in_parts

WINDOW = 2048
CHUNK = 256
END = 1
# With more sources, the places of chunks come from a table; what each task knows of the queues stays bounded.
MOST_QUEUES = 1024
_BLOCK_DOCUMENTS = 1 << 15
_UNIT = 1024  # shares of a window are held in parts of a token
_MOST_WORDS = 1_500_000
_PART_BYTES = 8 << 20  # of texts whose words are looked up at once

_TOKENS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("queue", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

#: The pieces that the vocabulary's own splitter cuts a normalised word into (fixed value of the file).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Punctuation that may follow a word of letters and is then a piece of its own.
_AFTER = b".,;:!?*%$#&|)"

#: Where letters end and such punctuation begins, the splitter cuts in any case: white space may stand there, and fewer words differ.
_WORD_END = r"([a-zß-öø-ÿ])([.,;:!?*%$#&|)])"


class _Known(dict):
    """Ids of words; those that there is no more room for are kept apart for a while."""

    def __init__(self) -> None:
        super().__init__()
        self.guests: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.guests[word]

    def add(self, words: list[bytes], ids: list[bytes]) -> None:
        room = max(0, _MOST_WORDS - len(self))
        self.update(zip(words[:room], ids[:room]))
        self.guests.update(zip(words[room:], ids[room:]))


class WordTokenizer:
    """Token ids of texts, word by word: the vocabulary drops white space, so a text's ids are those of its words in turn.
    Likewise a word of letters with punctuation after it has the ids of its two parts.

    Ids of up to ``_MOST_WORDS`` words are remembered; the others are encoded each time they come. New words are encoded
    many at a time; the vocabulary marks the end of each piece, which tells the words apart. Where that doesn't work out
    (special tokens in a text, say), words are encoded one by one.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.known = _Known()
        self.known[b""] = b""  # beside white space at an end of a text
        # for lower-cased Latin letters the normaliser and the splitter have nothing to do
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, words: list[bytes], letters: bool) -> list[bytes]:
        """The ids of each word; ``letters`` says that all are Latin letters only, and so one piece each."""
        text = " ".join([w.decode() for w in words])
        if letters:
            ids = np.array(self.plain.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, np.int64)
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        pieces = np.ones(len(words), np.int64)
        if not letters:
            pieces = np.array([len(_PIECE.findall(w)) for w in self.tokenizer.normalizer.normalize_str(text).split(" ")], np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(pieces) == len(words) and pieces.min() > 0 and len(ends) == pieces.sum() and ends[-1] == len(ids):
            raw, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
            cuts = (ends[np.cumsum(pieces) - 1] * width).tolist()
            return [raw[s:e] for s, e in zip([0, *cuts[:-1]], cuts)]
        one_by_one = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in one_by_one]

    def _learn(self, new: list[bytes]) -> None:
        joined, plain, odd = [], set(), set()
        for w in new:
            core = w.rstrip(_AFTER)
            text = core.decode()
            if text.isalpha() and (core.isascii() or max(text) < "\u0250" and text.lower().isalpha()):
                plain.add(core)
                if len(core) < len(w):
                    joined.append((w, core, w[len(core) :]))
                    odd.add(w[len(core) :])
            else:
                odd.add(w)
        for words, letters in ((plain, True), (odd, False)):
            words = [w for w in words if w not in self.known]
            for s in range(0, len(words), 1000):
                self.known.add(words[s : s + 1000], self._encode(words[s : s + 1000], letters))
        ids = self.known.__getitem__
        self.known.add([w for w, _, _ in joined], [ids(core) + ids(tail) for _, core, tail in joined])

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        # special tokens are told by their case, all other text is lower-cased by the vocabulary anyway
        lowered = [(t if b"<|" in t else t.translate(LOWER)) for t in (t or b"" for t in texts)]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        part = np.cumsum(sizes) // _PART_BYTES
        heads = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lowered)]
        return [ids for s, e in zip(heads, heads[1:]) for ids in self._ids(lowered[s:e])]

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """A word is looked up once, whatever the number of its places in the texts."""
        if not any(texts):
            return texts
        plain = pa.array([b"<|" not in t for t in texts])
        whole = pa.array(texts, pa.binary()).view(pa.string())
        apart = pc.replace_substring_regex(whole, _WORD_END, r"\1 \2")
        split = pc.ascii_split_whitespace(pc.if_else(plain, apart, whole))
        coded, texts_at = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        del whole, apart, split
        words = _values(coded.dictionary)
        ids = list(map(self.known.get, words))
        new = [i for i, known in enumerate(ids) if known is None]
        self._learn([words[i] for i in new])
        for i in new:
            ids[i] = self.known[words[i]]
        self.known.guests.clear()
        held, width = np.frombuffer(b"".join(ids), self.kind), np.dtype(self.kind).itemsize
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        word = coded.indices.to_numpy()
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n)
        place += np.arange(len(place))
        raw, cuts = held[place].tobytes(), (ends[texts_at] * width).tolist()
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]


def _values(words: pa.StringArray) -> list[bytes]:
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    held = data.to_pybytes()
    return [held[s:e] for s, e in zip(cuts, cuts[1:])]


_loaded: dict[str, WordTokenizer] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, th, queue, n, ids``: each row's ids with the end id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordTokenizer(path)
        tokenizer = _loaded[path]
        end = np.array([END], tokenizer.kind).tobytes()
        for batch in batches:
            for s in range(0, batch.num_rows, 2500):
                part = batch.slice(s, 2500)
                ids = [x + end for x in tokenizer(text_bytes(part.column("text")))]
                n = [len(x) // len(end) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), part.column("queue"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=_TOKENS)
                del ids
                give_back()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(of, "doc_id long, th long, queue string, n long, ids binary")


class Rounds:
    """The output places of chunks, from the queues' totals and their shares of a window."""

    def __init__(self, totals: list[int], shares: list[float], window: int, chunk: int):
        self.chunk = chunk
        self.total = np.array(totals, np.int64)
        self.quantum = np.maximum(1, np.floor(np.array(shares) / math.fsum(shares) * window * _UNIT)).astype(np.int64)
        self.last = -(-self.total * _UNIT // self.quantum)  # the round in which a queue runs out

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue was served after so many rounds (a row for each entry, a column for each queue)."""
        r = np.minimum(rounds[:, None], self.last)
        return np.where(r == self.last, self.total, r * self.quantum // (_UNIT * self.chunk) * self.chunk)

    def place(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Where chunk ``number`` of ``queue`` begins in the output."""
        out = np.empty(len(queue), np.int64)
        step = max(1, (1 << 20) // len(self.total))
        later = np.arange(len(self.total))[None, :]
        for s in range(0, len(queue), step):
            q, j = queue[s : s + step], number[s : s + step]
            end = np.minimum((j + 1) * self.chunk, self.total[q])
            now = -(-end * _UNIT // self.quantum[q])
            before, after = self.served(now - 1), self.served(now)
            mine = q[:, None]
            out[s : s + step] = np.where(later < mine, after, np.where(later > mine, before, 0)).sum(1) + j * self.chunk
        return out


def cut(begin: np.ndarray, n: np.ndarray, chunk: int, place_of: Callable[[np.ndarray, np.ndarray], np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """The pieces of documents that lie at ``begin`` in their queues: document, first token, length, output place.
    ``place_of`` tells where the chunks of documents (by the documents' and the chunks' numbers) begin in the output."""
    first, last = begin // chunk, (begin + n - 1) // chunk
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    at = np.maximum(number * chunk, begin[doc])
    length = np.minimum((number + 1) * chunk, (begin + n)[doc]) - at
    place = place_of(doc, number) + at - number * chunk
    start = at - begin[doc]
    # cut at the end of a sequence, then join neighbours that lie together in one
    room = window - place % window
    over = np.flatnonzero(length > room)
    doc, start, place, length = (np.insert(x, over + 1, y) for x, y in ((doc, doc[over]), (start, (start + room)[over]), (place, (place + room)[over]), (length, (length - room)[over])))
    split = over + np.arange(len(over))
    length[split] = room[over]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % window == 0)
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.add.reduceat(length, heads) if len(heads) else length, place[heads]


def _rates(queues: DataFrame, targets: Mapping[str, float] | None, window: int) -> DataFrame:
    """``queue, total, quantum``: each queue's parts of tokens a round, as in `Rounds`."""
    if targets:
        wanted = queues.sparkSession.createDataFrame([(q, float(x)) for q, x in targets.items()], "queue string, target double")
        queues = stash(queues.join(F.broadcast(wanted), "queue", "left"))  # a parameter is broadcast
        given = [r["target"] for r in queues.filter("target IS NOT NULL").orderBy("queue").select("target").collect()]
        mean = sum(given) / len(given) if given else 1.0
        total = float(sum(map(Fraction, given)) + (queues.count() - len(given)) * Fraction(mean))
        queues = queues.select("queue", "total", F.coalesce("target", F.lit(mean)).alias("share"))
    else:
        total = float(queues.agg(F.sum("total")).first()[0])
        queues = queues.withColumn("share", F.col("total").cast("double"))
    quantum = F.floor(F.col("share") / F.lit(total) * window * _UNIT).cast("long")
    return queues.select("queue", "total", F.greatest(F.lit(1).cast("long"), quantum).alias("quantum"))


def _chunk_places(placed: DataFrame, queues: DataFrame, chunk: int) -> DataFrame:
    """``queue, number, place``: where each chunk begins in the output. A chunk is made by the document that its first token
    lies in; chunks are output in the order of the rounds in which they are served, those of a round by queue."""
    spans = placed.select("queue", F.expr(f"(begin + {chunk - 1}) div {chunk}").alias("first"), F.expr(f"(begin + n - 1) div {chunk}").alias("last"))
    chunks = spans.filter("first <= last").select("queue", F.explode(F.sequence("first", "last")).alias("number")).join(queues, "queue")
    end = F.least((F.col("number") + 1) * chunk, F.col("total"))
    rounds = F.expr(f"cast((least((number + 1) * {chunk}, total) * {_UNIT} + quantum - 1) div quantum as long)")
    chunks = stash(chunks.select("queue", "number", rounds.alias("round"), (end - F.col("number") * chunk).alias("length")))
    before = running(chunks, [], ["round", "queue", "number"], {"place": Running("sum", "length", inclusive=False)})
    return before.select("queue", "number", F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def _with_places(placed: DataFrame, queues: DataFrame, chunk: int) -> DataFrame:
    """``placed`` with ``places``, those of all chunks that a document lies in, in order."""
    places = _chunk_places(placed, queues, chunk)
    number = F.explode(F.sequence(F.expr(f"begin div {chunk}"), F.expr(f"(begin + n - 1) div {chunk}")))
    found = placed.select("queue", "begin", number.alias("number")).join(places, ["queue", "number"])
    found = found.groupBy("queue", "begin").agg(F.array_sort(F.collect_list(F.struct("number", "place"))).alias("p"))
    return placed.join(found.select("queue", "begin", F.col("p.place").alias("places")), ["queue", "begin"])


def pack(docs: DataFrame, vocabulary: str | None = None, targets: Mapping[str, float] | None = None,
         window: int = WINDOW, chunk: int = CHUNK, most_queues: int = MOST_QUEUES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: the pieces of all documents, packed.

    A document is its text's ids and the end id. Sequences hold ``window`` tokens; only the last may hold fewer.
    ``targets`` maps sources to their share of tokens while they last (sources that it leaves out get the mean of the
    others); by default every source gets its share of all tokens, so that all last to the end.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are not looked at. A null text is empty and gives
    the end id alone; a null source is the source named by the empty string; rows without id are packed like others.
    Rows that repeat are packed as often as they come. An empty table gives no pieces. There may be any number of sources,
    each with a queue of its own; with more than ``most_queues`` the same places are found by joins.
    """
    path = vocabulary or default_vocabulary()
    tokens = stash(_tokens(docs, path))
    n_rows = tokens.count()
    blocks = max(8 * shuffle_partitions(docs.sparkSession), n_rows // _BLOCK_DOCUMENTS)
    tokens = tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", "th"), F.lit(blocks)))
    sums = stash(in_parts(tokens.groupBy("queue", "block").agg(F.sum("n").alias("n")), n_rows))
    totals_of = sums.groupBy("queue").agg(F.sum("n").alias("total"))
    totals = {r["queue"]: r["total"] for r in totals_of.limit(most_queues + 1).collect()}
    many = len(totals) > most_queues
    queues = [] if many else sorted(totals)
    if targets:
        given = [float(targets[q]) for q in queues if q in targets]
        shares = [float(targets.get(q, sum(given) / len(given) if given else 1)) for q in queues]
    else:
        shares = [float(totals[q]) for q in queues]
    rounds = Rounds([totals[q] for q in queues], shares, window, chunk) if queues else None
    numbers = {q: i for i, q in enumerate(queues)}
    kind = np.uint16 if _vocabulary_size(path) <= 1 << 16 else np.uint32

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, n = batch.column("begin").to_numpy(), batch.column("n").to_numpy()
            if many:
                places = batch.column("places")
                flat, base = places.flatten().to_numpy(), places.offsets.to_numpy()[:-1] - places.offsets[0].as_py() - begin // chunk
                place_of = lambda doc, number: flat[base[doc] + number]
            else:
                queue = np.array([numbers[q] for q in batch.column("queue").to_pylist()], np.int64)
                place_of = lambda doc, number: rounds.place(queue[doc], number)
            doc, start, length, place = cut(begin, n, chunk, place_of, window)
            ids = [memoryview(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            parts = [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
            crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
            columns = [batch.column("doc_id").take(pa.array(doc)), start, length, crc, n[doc], place // window, place % window]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], schema=_PIECES)
            del ids, parts
            give_back()

    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("queue", "block").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        tokens.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(base, ["queue", "block"])
        .select("doc_id", "queue", "n", "ids", (F.col("base") + F.col("inside")).alias("begin"))
    )
    if many:
        placed = _with_places(placed, stash(_rates(totals_of, targets, window)), chunk)
    return placed.mapInArrow(pieces, ", ".join(f"{f.name} long" for f in _PIECES))


def _vocabulary_size(path: str) -> int:
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1

"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, schemes, digit pairs, signs and the words that
announce an identifier. At each anchor a parser of its kind expands to the left and right as far as the kind's characters
go and validates what it has got; nothing else of the text is looked at.

Base kinds are the leftmost matches, that don't overlap, of their patterns: a match begins where the expansion to the left
ends or, if later, where the last match of its kind ended. Links with user data, account numbers and street addresses are
added to these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema

#: Kinds in their order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "link", "account", "address"]
_BASE = 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|id))?[.:#=\x20]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9][0-9-]{5,20}[0-9])(?![A-Za-z0-9])", re.I)
_HOUSE = re.compile(r"[0-9]{1,5}[a-z]?$")
_STREET = re.compile(r"(?:[A-ZÄÖÜ][\w'-]*\x20){1,3}$")

#: Words that announce an account number, and words that end the name of a street (fixed values).
ACCOUNT_CUES = ["account", "acct", "iban", "konto", "compte", "cuenta"]
STREET_CUES = ["street", "avenue", "road", "lane", "boulevard"]


def _automaton() -> ahocorasick.Automaton:
    words: dict[str, set[str]] = {}

    def add(word: str, kind: str) -> None:
        words.setdefault(word, set()).add(kind)

    add("@", "email")
    add("://", "link")
    for a in _DIGITS:
        add(f"{a}.", "ip")
        add(f"+{a}", "phone")
        for b in _DIGITS:
            for between in ("", " ", "-"):
                add(a + between + b, "card")
    for cue in ACCOUNT_CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            add(form, "account")
    for cue in STREET_CUES:
        add(f" {cue}", "address")
        add(f" {cue.capitalize()}", "address")
    out = ahocorasick.Automaton()
    for word, kinds in words.items():
        out.add_word(word, (len(word), tuple(sorted(kinds))))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    """Does the number's check digit hold?"""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _email(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    start = end - 1
    while start > last and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, end) if start < end - 1 else None
    return (start, domain.end(), True) if domain else None


def _ip(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    start = at
    while start > last and text[start - 1] in _DIGITS:
        start -= 1
    found = _QUAD.match(text, start) if start >= last else None
    return (start, found.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found[0].split("."))) if found else None


def _card(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    start = max(at, last)
    while start > last:
        if text[start - 1] in _DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 1 > last and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    found = _RUN.match(text, start)
    if not found:
        return None
    digits = found[0].replace(" ", "").replace("-", "")
    return start, found.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    found = _PHONE.match(text, at)
    return (at, found.end(), 9 <= sum(c in _DIGITS for c in found[0]) <= 15) if found else None


def _link(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    start = at
    while start > last and at - start < 12 and text[start - 1].isascii() and text[start - 1].isalnum():
        start -= 1
    found = _USER.match(text, end) if start < at else None
    return (start, found.end(), True) if found else None


def _account(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    found = _ACCOUNT.match(text, end)
    if not found or at and text[at - 1].isalnum():
        return None
    number = found[1].replace(" ", "")
    if number[0] in _DIGITS:
        return found.start(1), found.end(1), True
    turned = "".join(str(int(c, 36)) for c in (number[4:] + number[:4]).upper())
    return found.start(1), found.end(1), int(turned) % 97 == 1


def _address(text: str, at: int, end: int, last: int) -> tuple[int, int, bool] | None:
    """A house number, up to three capitalised words and the cue: ``12 Long Hill Road``."""
    if end < len(text) and text[end].isalnum():
        return None
    name = _STREET.search(text[max(last, at - 80) : at + 1])
    if not name:
        return None
    begin = max(last, at - 80) + name.start()
    house = _HOUSE.search(text[max(last, begin - 8) : begin].rstrip(" "))
    if not house:
        return None
    start = max(last, begin - 8) + house.start()
    return start, end, start == 0 or not text[start - 1].isalnum()


_PARSERS: dict[str, Callable] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "link": _link, "account": _account, "address": _address}
_ANCHORS = _automaton()


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all spans, in order of start and then kind; places count code points."""
    last, out = dict.fromkeys(KINDS, 0), []
    for at_end, (size, kinds) in _ANCHORS.iter(text):
        end = at_end + 1
        for kind in kinds:
            at = end - size
            if end - 1 < last[kind] or (kind != "email" and kind != "card" and at < last[kind] and kind != "ip"):
                continue
            found = _PARSERS[kind](text, max(at, last[kind]), end, last[kind])
            if found:
                last[kind] = found[1]
                if found[2]:
                    out.append((found[0], KINDS.index(kind), found[1]))
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row: counts of its base kinds, a digest of
    their spans, and all spans as text (``kind:start:end``, end exclusive, in order of start and then kind).

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at. A null text counts as empty and has no spans.
    Every row comes back, as often as it comes, rows without id too; an empty table gives no rows.
    """
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    schema = arrow_schema(ddl)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = spans(text or "")
                base = [s for s in found if s[1] < _BASE]
                kinds = [s[1] for s in base]
                out.append([*(kinds.count(k) for k in range(_BASE)), hashlib.sha256(written(base).encode()).hexdigest(), written(found)])
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, ddl)

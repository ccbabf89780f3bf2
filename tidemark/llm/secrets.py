"""Secret scans with multipart credential linking, in DataFrame operations alone.

Three kinds of secrets stand for themselves: assigned values, access keys and hex strings. Further parts of credentials
are weak: short access identifiers, short assigned values, logins in addresses and random-looking tokens, and endpoints. They
are joined with the other parts of their document by an interval of places, the scope, and reported only where complementary
parts meet: an identifier with a secret, a secret with an identifier or an endpoint, an endpoint with both. A token of letters
in one case and digits is a secret only beside an identifier.

Each pattern is looked for apart from the others, so an endpoint doesn't hide what it carries: identifiers, a login, and the
values of its parameters are parts of their own. Other pieces of an endpoint, its path say, are no secrets.

A place follows from the text between matches: a pattern's matches and the pieces between them, in turn, make up the text,
so a match's end is a running sum of lengths. The interval join is made of running maxima of ends and minima of starts, so
no pairs are made and a part may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key

# Places, at most, between the end of a part and the start of the next that belongs to it.
SCOPE = 200

#: The patterns of the three base kinds, in their order (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Endpoints, the logins in them, identifiers of other makes, and tokens between other characters.
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{1,14}://[^\s"'<>]+"""
LOGIN = r"""(?<=://)[^\s/?#:@"'<>]{1,128}:[^\s/?#@"'<>]{1,128}(?=@)"""
ID = r"(?<![A-Za-z0-9_])A(?:SIA|IDA|ROA)[A-Z0-9]{12,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])"
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
_BASE = 3


def _matches(pattern: str, name: str) -> list[Column]:
    return [F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(f"m_{name}"), F.split("text", pattern, -1).alias(f"g_{name}")]


def _parts(name: str) -> Column:
    """Of each match: its pattern, number, text, the length of the text before it since the last match, and that text's last
    character."""
    def part(m: Column, i: Column) -> Column:
        gap = F.element_at(f"g_{name}", i + 1)
        return F.struct(F.lit(name).alias("pattern"), i.alias("i"), m.alias("m"), F.length(gap).cast("long").alias("gap"), F.right(gap, F.lit(1)).alias("prev"))

    none = F.array().cast("array<struct<pattern:string,i:int,m:string,gap:bigint,prev:string>>")
    return F.when(F.size(f"m_{name}") > 0, F.transform(f"m_{name}", part)).otherwise(none)


def _mixed() -> Column:
    return F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Z]") & F.col("m").rlike("[a-z]")


def _kind() -> Column:
    """The number of a match's kind in ``KINDS``; null if it is none."""
    value = F.length(F.regexp_extract("m", ASSIGN, 1))
    one_case = F.col("m").rlike("^([a-z0-9]+|[A-Z0-9]+)$") & F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Za-z]")
    return (
        F.when(F.col("pattern") == "assign", F.when(value >= 12, 0).when(value >= 6, 4))
        .when(F.col("pattern") == "access", F.when(F.length("m") >= 18, 1).when(F.length("m") >= 12, 3))
        .when(F.col("pattern") == "hex", 2)
        .when(F.col("pattern") == "endpoint", 5)
        .when(F.col("pattern") == "id", 3)
        .when(F.col("pattern") == "login", 4)
        .when(~F.col("m").rlike("^A(SIA|IDA|ROA)[A-Z0-9]+$") & (_mixed() | one_case), 4)
    )


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, th, kind, start, end, links``: all spans, one row each, of the different rows of ``docs``.

    ``kind`` is a number in ``KINDS``; ``start`` and ``end`` (exclusive) count code points. Base spans (the first three
    kinds) are all there, overlapping or not; a weak part is there if it overlaps no base span (endpoints may) and a complementary
    part ends at most ``scope`` before its start, or starts at most ``scope`` after its end. ``links`` names the complementary parts
    that a weak part meets (``id``, ``secret``, ``endpoint``, joined by ``+``) and is null for base spans. ``docs`` has ``doc_id`` and
    ``text``; ``th`` is ``xxhash64`` of the text. A null text counts as empty and has none; an empty table has no spans.
    """
    names = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "endpoint": ENDPOINT, "login": LOGIN, "id": ID, "token": TOKEN}
    matched = row_key(docs).filter("length(text) > 0").select("doc_id", "th", *[c for n, p in names.items() for c in _matches(p, n)])
    parts = (
        matched.select("doc_id", "th", F.explode(F.concat(*[_parts(n) for n in names])).alias("p"))
        .select("doc_id", "th", "p.*")
        .dropDuplicates(["doc_id", "th", "pattern", "i"])  # rows that repeat are looked at once
    )
    so_far = Window.partitionBy("doc_id", "th", "pattern").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(so_far)
    placed = parts.select(
        "doc_id", "th", "pattern", "prev", (end - F.length("m")).alias("start"), end.alias("end"), _kind().alias("kind"),
        ((F.col("pattern") == "token") & ~_mixed()).alias("one_case")).filter("kind is not null")
    row = Window.partitionBy("doc_id", "th").orderBy("start")
    up, down = row.rangeBetween(Window.unboundedPreceding, 0), row.rangeBetween(0, Window.unboundedFollowing)
    kind, is_base = F.col("kind"), F.col("kind") < _BASE
    covered = (F.coalesce(F.max(F.when(is_base, F.col("end"))).over(up), F.lit(-1)) > F.col("start")) | (
        F.coalesce(F.min(F.when(is_base, F.col("start"))).over(down), F.col("end")) < F.col("end"))
    # pieces of an endpoint are parts only as values of its parameters
    piece = (F.col("pattern") == "token") & (F.coalesce(F.max(F.when(kind == 5, F.col("end"))).over(up), F.lit(-1)) > F.col("start")) & (F.col("prev") != "=")
    placed = placed.withColumns({"covered": covered, "piece": piece}).filter(is_base | (kind == 5) | ~(F.col("covered") | F.col("piece"))).drop("covered", "piece", "prev", "pattern")

    def near(*kinds: int) -> Column:
        """Is there such a part within the scope, before or after?"""
        of = F.col("kind").isin(*kinds)
        ends = F.max(F.when(of, F.col("end"))).over(up) >= F.col("start") - scope
        return F.coalesce(ends, F.lit(False)) | F.coalesce(F.min(F.when(of, F.col("start"))).over(down) <= F.col("end") + scope, F.lit(False))

    placed = placed.withColumns({"id": near(1, 3), "secret": near(0, 2, 4), "endpoint": near(5)})
    linked = (
        F.when(kind == 3, F.col("secret")).when(kind == 4, F.col("id") | (F.col("endpoint") & ~F.col("one_case")))
        .otherwise(F.col("id") & F.col("secret")))
    role = F.when(kind == 3, "id").when(kind == 4, "secret").otherwise("endpoint")
    links = F.concat_ws("+", *[F.when(F.col(c) & (role != c), c) for c in ("id", "secret", "endpoint")])
    return placed.filter(is_base | linked).select("doc_id", "th", "kind", "start", "end", F.when(~is_base, links).alias("links"))


def _written(spans: str, most: int) -> Column:
    """``kind:start:end`` of the spans whose kind is below ``most``, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < most), _name), ",")


def _name(span: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(":", F.element_at(names, span["kind"] + 1), span["start"], span["end"])


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, links``: for every row the counts of its base spans, a digest of
    these, and all spans as text, in order of start and then kind (see `secret_spans`); ``links`` has the weak ones, each with
    the complementary parts that it meets (``id:40:60~secret+endpoint``).

    Every row of ``docs`` comes back, as often as it comes; rows with a null or empty text have no spans, rows without
    id are scanned like others; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
    """
    found = secret_spans(docs, scope).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "links"))).alias("found"))
    rows = row_key(docs).select("doc_id", "th")
    joined = rows.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.th = f.th"), "left").select("d.doc_id", "found")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,links:string>>")
    joined = joined.withColumn("found", F.coalesce("found", none))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written("found", _BASE), 256).alias("base_sha256"), _written("found", len(KINDS)).alias("spans"),
        F.array_join(F.transform(F.filter("found", lambda s: s["kind"] >= _BASE), lambda s: F.concat_ws("~", _name(s), s["links"])), ",").alias("links"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs``, all columns and rows, with every secret in ``text`` replaced by ``mark`` (spans that overlap by one).
    ``n_chars``, if there is such a column, becomes the new text's length where secrets were replaced."""
    row = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        secret_spans(docs, scope).withColumn("new", F.when(F.coalesce(reach <= F.col("start"), F.lit(True)), 1).otherwise(0))
        .withColumn("run", F.sum("new").over(row))
        .groupBy("doc_id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    runs = runs.withColumn("prev", F.coalesce(F.lag("end").over(row), F.lit(0)))
    cuts = runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "prev", "end"))).alias("cuts"), F.max("end").alias("last"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.struct("cuts", "last").alias("_cuts"))
    text = F.expr(
        "concat_ws('', array_join(transform(_cuts.cuts, s -> substring(text, int(s.prev + 1), int(s.start - s.prev))), :mark), :mark, substring(text, int(_cuts.last + 1)))".replace(":mark", "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    kept = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    joined = kept.join(cuts, F.expr("_doc <=> _id AND _hash = _th"), "left")
    new = joined.withColumn("_text", F.when(F.col("_cuts").isNotNull(), text).otherwise(F.col("text")))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        length = F.length("_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_cuts").isNotNull(), length).otherwise(F.col("_row")["n_chars"])
    return new.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])

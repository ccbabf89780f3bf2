"""The registered queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    language, lexical, licenses, neighbours, packing, pages, personal, quality, runs, secrets, simhash, suffixes, winnowing,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_digests(table(spark, folder, "documents"))


def op2_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages"))


def op6_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op9_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_anchor_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_data(table(spark, folder, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in the texts of ids whose crc32 ends in 0, the words from some place on repeat themselves at a period."""
    keyed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = keyed.withColumn("_ws", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.nullif(F.size("_ws"), F.lit(0)))
    placed = split.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("_g % _n")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    new = F.expr("array_join(transform(_ws, (w, i) -> if(i >= _a, _ws[int(_a + (i - _a) % _p)], w)), ' ')")
    return placed.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(with_repeats(table(spark, folder, "documents"))))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_winnowing_decontamination": op2_winnowing_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_site_templates": op5_site_templates,
    "op6_mixture_packing": op6_mixture_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_multi_index_hashing": op9_multi_index_hashing,
    "op10_anchor_pii": op10_anchor_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_license_scan": op13_license_scan,
}

SQL: dict[str, str] = {}

SQL["op1_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(ws, i, i + 12) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)
), firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), hits AS (
  SELECT doc_id, unnest(range(i, i + 13)) AS pos FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id
), removed AS (
  SELECT doc_id, list(DISTINCT pos) AS gone FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string([ws[j] FOR j IN range(1, len(ws) + 1) IF gone IS NULL OR NOT list_contains(gone, j)], ' '), '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

SQL["op2_winnowing_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, list_slice(ws, i, i + least(13, len(ws)) - 1) AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM item_words WHERE len(ws) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows))
), found AS (
  SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, w)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op11_periodic_runs"] = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i : CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) r(b)
), hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda a, b : xor(a // 256, t[xor(a % 256, b) + 1]))) AS h
  FROM documents, crc_table
), placed AS (
  SELECT *, (h // 10) % nullif(len(ws), 0) AS a, 1 + (len(ws) - (h // 10) % nullif(len(ws), 0)) // (3 + (h // 10) % 8) AS p FROM hashed
), words AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(ws) > 0
    THEN [CASE WHEN i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END FOR i IN range(len(ws))] ELSE ws END AS ws FROM placed
), tokens AS (
  SELECT r, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words
), equal AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM tokens x JOIN tokens y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal) GROUP BY r, q, g
  HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
    list_distinct(flatten(list(range(start + period, start + length)))) AS gone
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[i + 1] FOR i IN list_filter(range(len(ws)), lambda j : NOT list_contains(gone, j))] END, ' '), '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (r)
"""

SQL["op12_ranked_search"] = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (
  SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM doc_terms WHERE len(ws) > 0
), postings AS (
  SELECT r, doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM doc_terms)
  GROUP BY r, doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs
), scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item_terms JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{p.label}', {p.base}, {p.share}, {p.slack}, {p.gram}, {len(p.grams)}, {t}, '{g}')"
    for n, p in enumerate(licenses.TEMPLATES) for t, g in enumerate(p.grams)
)

SQL["op13_license_scan"] = r"""
WITH grams(template, label, base, needed, slack, k, n_grams, t, gram) AS (VALUES :templates), templates AS (
  SELECT DISTINCT template, label, base, needed, slack, n_grams FROM grams
), words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), places AS (
  SELECT r, k, p, array_to_string(list_slice(ws, p + 1, p + k), ' ') AS gram
  FROM (SELECT r, ws, unnest(range(len(ws))) AS p FROM words), (SELECT DISTINCT k FROM grams)
), votes AS (
  SELECT DISTINCT r, template, p - t AS diagonal, t FROM places JOIN grams USING (k, gram)
), diagonals AS (
  SELECT r, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT r, template, diagonal FROM votes) JOIN templates USING (template)
), merged AS (
  SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM diagonals
), spans AS (
  SELECT r, template, span, count(DISTINCT t) AS held, min(diagonal + t) AS start FROM votes JOIN merged USING (r, template, diagonal) GROUP BY r, template, span
), verified AS (
  SELECT r, start, label, base, held / n_grams AS share FROM spans JOIN templates USING (template) WHERE held / n_grams >= needed
), found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM verified GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (r)
""".replace(":templates", _TEMPLATE_ROWS)

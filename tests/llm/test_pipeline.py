"""The stages of the pipeline against plain versions, and the queries against their SQL."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from odd import PASSAGE, documents

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_queries import normal, rows_of
from tidemark.llm import common, packing, quality, simhash, winnowing
from tidemark.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = kept["quality"]
    bad = {r.doc_id for r in quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r.predicted}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = kept["near_duplicates"]
    fps = {r.doc_id: simhash.simhash(r.text.encode()) for r in before.collect()}
    left = {r.doc_id for r in after.collect()}
    for doc, fp in fps.items():  # who goes has a kept or smaller neighbour; those kept are apart
        near = [d for d, f in fps.items() if d != doc and (f ^ fp).bit_count() <= 3]
        assert (doc in left) or min(near) < doc
        assert not (doc in left and left & set(near))
    before, after = kept["decontamination"]
    found = winnowing.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found if not r.contaminated}
    before, after = kept["secrets"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text) and r.n_chars == len(r.text)
        assert ("[SECRET]" in r.text) == (r.text != old[r.doc_id])
    before, after = kept["packing"]
    tokens = packing.WordTokenizer(packing.default_vocabulary())
    sizes = {r.doc_id: len(np.frombuffer(tokens([r.text.encode()])[0], tokens.kind)) + 1 for r in before.collect()}
    packed = Counter()
    for r in after.collect():
        packed[r.doc_id] += r.length
    assert packed == sizes


@pytest.mark.parametrize("largest_broadcast", [common.BROADCAST_BYTES, 0])
def test_small_tables_are_written_in_few_files(spark, monkeypatch, largest_broadcast):
    """However many shuffle partitions there are: files are many processes at a time where they are local."""
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    few = spark.conf.get("spark.sql.shuffle.partitions")
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    stages = {
        "quality": lambda: quality.keep_good(docs, labels), "near_duplicates": lambda: simhash.keep_one(docs),
        "decontamination": lambda: winnowing.decontaminate(docs, items), "packing": lambda: packing.pack(docs)}
    want = {name: Counter(tuple(r) for r in stage().collect()) for name, stage in list(stages.items())[:3]}
    monkeypatch.setattr(common, "BROADCAST_BYTES", largest_broadcast)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for name, stage in stages.items():
            before = set(folder.rglob("part-*"))
            out = stage()
            files = set(folder.rglob("part-*")) - before
            written = Counter(str(f.parent) for f in files)
            # what holds texts or comes of them task by task may have a part for each partition
            assert sum(n > docs.rdd.getNumPartitions() for n in written.values()) <= (name == "decontamination")
            if name in want:
                assert Counter(tuple(r) for r in out.collect()) == want[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)


def test_stages_bear_odd_rows(spark, tmp_path):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_winnowing_decontamination"])
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows_of(normal(queries()[name](spark, SF).toPandas())) == rows_of(normal(duck.sql(oracle_sql()[name]).df()))


def test_every_operator_is_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


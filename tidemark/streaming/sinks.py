"""Where live results go, when a batch runs, and what is reported about it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from tidemark.functions.text import format_row, format_span

# A batch every ten seconds unless asked otherwise.
EVERY_TEN_SECONDS = {"processingTime": "10 seconds"}
UNTIL_DONE = {"availableNow": True}


def _writer(df: DataFrame, mode: str, trigger: dict | None, checkpoint: str | None) -> DataStreamWriter:
    writer = df.writeStream.outputMode(mode).trigger(**(trigger or EVERY_TEN_SECONDS))
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer


def to_console(df: DataFrame, mode: str = "append", trigger: dict | None = None, checkpoint: str | None = None):
    """Print the rows of each batch in full."""
    return _writer(df, mode, trigger, checkpoint).format("console").option("truncate", "false")


def formatted(df: DataFrame, start: str = "start_ms", end: str = "end_ms", key: str = "key") -> DataFrame:
    """One text column ``value``: ``(start,end,key,count)``."""
    return df.select(format_row(F.col(start), F.col(end), F.col(key), F.col("count")).alias("value"))


def to_text(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Results as lines in text files; final results only, each written exactly once."""
    return _writer(formatted(df), "append", trigger, checkpoint).format("text").option("path", path)


def write_text(df: DataFrame, path: str) -> None:
    """The batch form: replace what is there with these results."""
    formatted(df, *[c for c in ("start", "end") if c in df.columns] or ("start_ms", "end_ms")).write.mode(
        "overwrite"
    ).text(path)


def to_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append", trigger: dict | None = None):
    """Lines to a log topic, keyed by the window's key. The connector has to be on the class path."""
    lines = df.select(
        F.col("key"), format_row(F.col("start_ms"), F.col("end_ms"), F.col("key"), F.col("count")).alias("value")
    )
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    return _writer(lines, mode, trigger, checkpoint).format("kafka").options(**options)


def to_each_batch(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None
):
    """Hand every batch to ``write(rows, batch number)``."""
    return _writer(df, mode, trigger, checkpoint).foreachBatch(write)


class _ChangeLog:
    """Changed counts by batch, ``path/batch=n``, and from time to time a snapshot of the newest counts,
    ``path/_snapshots/upto=n``. A folder counts once it has Spark's mark of success."""

    def __init__(self, path: str, keys: list[str], snapshot_every: int):
        self.path, self.keys, self.every = path, keys, snapshot_every

    def write(self, rows: DataFrame, batch: int) -> None:
        """One batch; run again, it replaces what it wrote. Every ``snapshot_every`` batches a new snapshot is made of the one
        before and the batches since."""
        rows.withColumn("changed_in", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.every == 0:
            self.newest(rows.sparkSession, batch).write.mode("overwrite").parquet(f"{self.path}/_snapshots/upto={batch}")

    def newest(self, spark: SparkSession, made_at: int | None = None) -> DataFrame:
        """The newest count per window and key, from the last snapshot (one made at ``made_at`` doesn't count) and the tail."""
        snapshots = [n for n in _numbered(spark, f"{self.path}/_snapshots", "upto") if n != made_at]
        upto = max(snapshots, default=-1)
        folders = [f"{self.path}/batch={n}" for n in _numbered(spark, self.path, "batch") if n > upto]
        folders += [f"{self.path}/_snapshots/upto={upto}"] if snapshots else []
        if not folders:
            raise ValueError(f"no batch has been written to {self.path}")
        group = ["start_ms", "end_ms", *self.keys]
        newest = spark.read.parquet(*folders).groupBy(*group).agg(F.max(F.struct("changed_in", "count")).alias("_newest"))
        return newest.select(*group, "_newest.count", "_newest.changed_in")


def _numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers ``n`` of the complete folders ``name=n``. The driver lists names only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def to_changelog(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keys: list[str] | None = None, snapshot_every: int = 20
):
    """Every change of a count as it happens, and every ``snapshot_every`` batches a snapshot, so that a look at the counts
    (`latest`) reads one snapshot and the batches since. A batch that is run again replaces its own folders."""
    log = _ChangeLog(path, ["key"] if keys is None else keys, snapshot_every)
    return to_each_batch(df, log.write, checkpoint, "update", trigger)


def latest(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The change log as a table: the newest count per window and key, as of the last complete batch."""
    return _ChangeLog(path, ["key"] if keys is None else keys, 1).newest(spark).drop("changed_in")


def late_lines(late: DataFrame, time: str) -> DataFrame:
    """A text report of late rows (``time`` in milliseconds), one line ``value`` for each row: ``(time,time,1)``, the report of a
    count window of one row."""
    return late.select(format_span(F.col(time), F.col(time), F.lit(1)).alias("value"))


def write_late_text(late: DataFrame, time: str, path: str) -> None:
    """The report of late rows as text files, in place of what is there."""
    late_lines(late, time).write.mode("overwrite").text(path)


def to_results_and_late(
    df: DataFrame, results: str, late: str, checkpoint: str, trigger: dict | None = None, late_as_text: bool = False
):
    """Split a stream with a ``pane_kind`` column: rows marked ``late_row`` to one folder, reports to
    another, in the same batch. A batch that is run again replaces its own files. ``late_as_text`` writes late rows as a
    text report (`late_lines`) and not as Parquet."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            late_rows = rows.filter("pane_kind = 'late_row'")
            if late_as_text:
                write_late_text(late_rows, "start_ms", f"{late}/batch={batch}")
            else:
                late_rows.write.mode("overwrite").parquet(f"{late}/batch={batch}")
            rows.filter("pane_kind <> 'late_row'").write.mode("overwrite").parquet(f"{results}/batch={batch}")
        finally:
            rows.unpersist()

    return to_each_batch(df, write, checkpoint, "append", trigger)


def result_name(window: str, source: str, early: bool = False, late: bool = False, keyed: bool = True) -> str:
    """A file name that tells the variants of a job apart."""
    parts = [window, "early" if early else "", "late" if late else "", "for", source, "keyed" if keyed else ""]
    return "-".join(part for part in parts if part) + ".txt"


class ProgressLog(StreamingQueryListener):
    """Passes the progress of every batch on as JSON (default: prints it)."""

    def __init__(self, write: Callable[[str], None] = print):
        self._write = write

    def onQueryStarted(self, event) -> None:
        self._write(json.dumps({"started": event.name or str(event.id)}))

    def onQueryProgress(self, event) -> None:
        self._write(event.progress.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(json.dumps({"terminated": str(event.id)}))


class DroppedLate(StreamingQueryListener):
    """Counts the rows that the watermark dropped, over all batches and stateful steps of each query.

    A query itself remembers only its last batches, so the counts are added up as batches end. Register it with
    ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self._rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        dropped = sum(operator["numRowsDroppedByWatermark"] for operator in progress["stateOperators"])
        self._rows[progress["runId"]] = self._rows.get(progress["runId"], 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, query) -> int:
        """Rows dropped so far by this run of the query, as far as its batches were reported."""
        return self._rows.get(str(query.runId), 0)

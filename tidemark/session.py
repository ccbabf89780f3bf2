"""Session helpers: a local session for tests, UTC pinning, and lineage cuts that survive executor loss."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A derived side is broadcast only after its row count was seen to be at most this many rows,
# and, if its rows hold lists, its size to be at most this many bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Rows of a partition of a small table that is written (see ``in_parts``).
PART_ROWS = 4096


def local_session(name: str = "tidemark", cores: str = "*", conf: dict | None = None) -> SparkSession:
    """A small local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times are compared as epoch numbers, so zone-less timestamps must be read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would be lost with the executor that wrote it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def in_parts(df: DataFrame, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` in as many partitions as about ``rows`` rows need, and in no more than it has, so that a small table is not written
    as a file for every shuffle partition. On local disks Hadoop starts a process for each file (``chmod``), which shares the
    executor's memory until it runs and is counted once more if one looks just then."""
    return df.coalesce(max(1, -(-rows // part_rows)))


def written(df: DataFrame) -> DataFrame:
    """`materialise` for what is joined with itself again and again: Parquet, whose size Spark sees. A checkpoint keeps the size
    that was expected before, and as a join's is the product of its sides', its digits multiply with every round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(materialised: DataFrame, rows: int) -> bool:
    """Does this (materialised) DataFrame have at most ``rows`` rows? Its rows are written, so they are counted where
    they are; a limit would send that many from every partition to one task."""
    return materialised.count() <= rows


def expected_bytes(df: DataFrame) -> int:
    """Size of ``df`` as Spark expects it from the sizes of its files; nothing is run. Where nothing is known, very large."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # more digits than Python reads
        return sys.maxsize


def in_ranges(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df``, written once, with the number ``name`` of the range of ``order`` that a row is in. Ranges hold about equally many
    rows, however the values lie; there are ``parts`` of them, or as many as the session has shuffle partitions."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id().cast("bigint")))


def broadcast_if_small(df: DataFrame, rows: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` only if it is known to be small.

    ``rows`` is a materialised DataFrame with at least as many rows (``df`` itself, if it is
    materialised). Beyond the limit the join is left to the planner, which then shuffles both
    sides and splits skewed partitions.
    """
    return F.broadcast(df) if at_most(df if rows is None else rows, max_rows) else df


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join on columns in which NULL equals NULL (a key may be missing)."""
    renamed = right.select(
        *[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for column in on:
        condition = condition & F.col(column).eqNullSafe(F.col(f"_right_{column}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in on])

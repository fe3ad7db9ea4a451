"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | None = None, app: str = "splitsight") -> SparkSession:
    """A local session with the settings used by the tests and the bench."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names; fall back only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="splitsight-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name beside the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions before each of them becomes many.

    A fixed partition number keeps adaptive execution from merging the partitions by their size
    before the rows multiply; hashing by key keeps retried tasks deterministic.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


TASK_ROWS = 250_000  # rows that a task sorts and combines at once


def task_parts(rows: int) -> int:
    """Parts of about TASK_ROWS that `rows` rows make."""
    return -(-rows // TASK_ROWS)


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash a table of about `rows` rows over parts of about TASK_ROWS, where it has more of these than cores.

    Adaptive execution merges partitions up to 64 MB as shuffled, and a session may have few of them; sorted and
    combined, these rows take twenty times as much. Here what a task holds does not grow with the table. Smaller
    tables are left to adaptive execution, which gives every core a part.
    """
    parts = task_parts(rows)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df

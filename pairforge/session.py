"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "8", app: str = "pairforge", memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables with much work per row should still use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster must name one that every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _local_root() -> str:
    """One folder for the local sessions of this process, deleted at its end."""
    root = tempfile.mkdtemp(prefix="pairforge-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/pairforge-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage of results that several branches of one job use. Unlike
    a checkpoint the copy is columnar, so each branch reads only its columns,
    and its size is known to the optimizer.
    """
    path = fresh_path(df.sparkSession, name)
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lists that gather the paths of stored tables; whoever adds one deletes them.
owners: list[list[str]] = []


def small_side(df: DataFrame, name: str, max_rows: int = 100_000) -> DataFrame:
    """Store one side of a join and broadcast it only if it is counted small.

    A larger one is joined by shuffle, where adaptive execution splits hot keys.
    """
    kept = stored(df, name)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys``, in as many tasks as their bytes call for.

    Adaptive execution joins small partitions and splits large ones, hot keys
    too, so the number of tasks follows the data and not a setting.
    """
    return df.hint("rebalance", *keys)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan out to all tasks if its files give too few.

    For work that costs far more per byte than a shuffle. A table of many
    files has splits enough and is left as it is. ``keys`` should be unique.
    """
    if scan.rdd.getNumPartitions() >= scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return balanced(scan, *keys)

"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of one group that a single task may sort. Larger groups are split.
HOT = 1_000_000


def local_session(cores: str = "*", partitions: int = 8, app: str = "limnos") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


# Folders of local file systems that a round of tasks has written to and the session has read whole.
_seen: set[tuple[str, str]] = set()


def _sees_all(spark: SparkSession, folder: str) -> bool:
    """Does what tasks on all cores write to ``folder`` come back? The session forgets where it does not, so a mount mended meanwhile is tried again."""
    known = (spark.sparkContext.applicationId, folder)
    if known not in _seen:
        path, tasks = f"{folder}/limnos/probe-{uuid.uuid4().hex}", max(2, spark.sparkContext.defaultParallelism)
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        if spark.read.schema("id long").parquet(path).count() != tasks:
            return False
        _seen.add(known)
    return True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``; without it, on a cluster, a named warehouse, which all executors see as well.

    Only a local session with neither gets a temporary folder of its own. On a cluster the folder may be a mount that all machines share, which looks like
    a folder of the machine's own file system: such a one is tried once, and refused if rows that tasks write there do not come back.
    ``spark.limnos.sharedMount`` (``true``) spares the trial.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")
    if not configured and not local:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        # Spark fills the setting in, with a folder below the driver's own.
        if warehouse and spark._jvm.org.apache.hadoop.fs.Path(warehouse).toUri().getPath() != f"{os.getcwd()}/spark-warehouse":
            configured = warehouse
    if configured:
        folder = configured.rstrip("/")
        if not local and spark.conf.get("spark.limnos.sharedMount", "false") != "true":
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
            if scheme == "file" and not _sees_all(spark, folder):
                raise RuntimeError(f"{folder} is local to each machine; name a folder that all executors share")
        return folder
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="limnos-")
    spark.sparkContext.setCheckpointDir(own)
    return own


# Folders of intermediate tables made since the innermost open scope began.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/limnos/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end. Results that read them must be written or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its source has fewer partitions than that: for dear work on each row of a table in a single file or row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage in a way that outlives executors, and gives Catalyst the true
    size of the table: a join against it is broadcast only when the files are
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session set-up and the shared folder intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}
_WRITTEN: defaultdict[str, list[str]] = defaultdict(list)
_MOUNTS: set[tuple[str, str]] = set()


def build_session(app: str = "adtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps.

    Shuffle partitions stay the cluster's choice; adaptive execution coalesces
    them. The state store only matters for the optional watermark mode.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Event times are instants; windows and casts must not follow a local zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only right when there is one machine, so it is
    used in local mode alone; on a cluster an unset folder is an error. A cluster
    without a file system of its own shares folders by mounting them, so there a
    ``file:`` folder is tried out once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        default = urlparse(context._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
        if (urlparse(named).scheme or default) == "file" and not context.master.startswith("local"):
            if default != "file" or not _mounted(spark, named):
                raise RuntimeError(f"spark.checkpoint.dir ({named}) is a folder of one machine; name one all executors share")
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        # Goes away with this process.
        _LOCAL_FOLDERS[context.applicationId] = tempfile.TemporaryDirectory(
            prefix="adtally-", ignore_cleanup_errors=True
        )
    return _LOCAL_FOLDERS[context.applicationId].name


def _mounted(spark: SparkSession, folder: str) -> bool:
    """Whether the rows that tasks write to ``folder`` are found there again; asked once an application."""
    context = spark.sparkContext
    if (context.applicationId, folder) not in _MOUNTS:
        path, rows = f"{folder.rstrip('/')}/adtally/mounted-{uuid.uuid4().hex}", context.defaultParallelism
        spark.range(0, rows, 1, rows).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
        _delete(spark, path)
        if found != rows:
            return False
        _MOUNTS.add((context.applicationId, folder))
    return True


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, until :func:`clear_intermediates`."""
    path = f"{shared_folder(spark)}/adtally/{name}-{uuid.uuid4().hex}"
    _WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def clear_intermediates(spark: SparkSession) -> int:
    """Delete everything this session has put in the shared folder; how many paths there were.

    For when all results have been read or written elsewhere.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        _delete(spark, name)
    return len(paths)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    Cuts the lineage, fixes values that would not be evaluated the same way
    twice (row ids, sketches), and gives Catalyst real sizes to plan with.
    """
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        if "/adtally/" in folder:
            _delete(frame.sparkSession, folder)

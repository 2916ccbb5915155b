"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def get_spark(
    master: str | None = None, partitions: int | None = None, memory: str | None = None
) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName("codeloom")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Hash joins where a partition's measured size allows it, sorts beyond.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``.

    Every executor must reach it, so a cluster has to name it.  A local session, whose executors
    are the driver itself, gets a temporary folder where none is set.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{key} must name a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _local_root() -> str:
    """One folder per process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="codeloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def stored(table: DataFrame, label: str) -> DataFrame:
    """``table`` written to the shared folder and read back.

    For a result read several times: the work is done once, the lineage is cut,
    and a lost executor costs nothing that was already written.
    """
    path = scratch_path(table.sparkSession, label)
    table.write.parquet(path)
    out = table.sparkSession.read.schema(table.schema).parquet(path)
    _stored[out] = path
    return out


#: Where stored tables lie.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more; other tables are left alone.

    Only for what later stored tables were made from: those are complete, so that a lost executor
    never asks for these files again.
    """
    for table in tables:
        if path := _stored.pop(table, None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

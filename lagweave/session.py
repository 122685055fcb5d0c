"""Session helpers: the package on executors, and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that functions of its modules unpickle there."""
    context = spark.sparkContext
    if getattr(context, "_lagweave_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="lagweave-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._lagweave_shipped = True


_fallback_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback_dir:
        _fallback_dir.append("file://" + tempfile.mkdtemp(prefix="lagweave-"))
    return _fallback_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lagweave/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go when their query ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors, frees the shuffles behind it."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pinned_path = path
    return out


def hadoop_path(df: DataFrame):
    """The file system and path of what pin() wrote."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._pinned_path)
    return p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), p


def unpin(*frames: DataFrame) -> None:
    """Delete what pin() wrote, once nothing reads it any more."""
    for df in frames:
        if getattr(df, "_pinned_path", None):
            fs, p = hadoop_path(df)
            fs.delete(p, True)

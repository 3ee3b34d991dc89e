"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC timestamps, last key wins in maps, and runtime re-planning with skew splitting.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName("shelfmark")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; deleted when the session's JVM ends.

    Where that is unset, a local session gets a folder of its own, and any other session is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = sc.getCheckpointDir() or os.path.join(tempfile.gettempdir(), "checkpoints", "shelfmark")
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/shelfmark/{what}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    # as the file system itself spells it
    return fs.makeQualified(target).toString()


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df``, computed once, written where all executors find them, and read back."""
    path = f"{scratch(df.sparkSession, what)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; the cluster's own settings win where it has any."""
    b = SparkSession.builder.appName("tilespark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary folder stands in where that is unset on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tilespark.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tilespark-")
        spark.conf.set("tilespark.shared.dir", root)
    return f"{root.rstrip('/')}/tilespark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read from there: what stands on them several times does not work them out again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, name: str, default: str | None = None) -> str:
    """The session's ``tilespark.<name>`` (as ``data.root``, ``index.root``); without a default it has to be set, and an empty value is none."""
    value = spark.conf.get(f"tilespark.{name}", None) or default
    if value is None:
        raise ValueError(f"set tilespark.{name}, as with --conf tilespark.{name}=...")
    return value

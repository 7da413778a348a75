"""Sessions and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PINNED: dict[str, list[str]] = {}


def session(app: str = "evidentia", **conf: str) -> SparkSession:
    """A session with the settings that this library counts on: UTC and adaptive execution."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; else a folder of this machine, as in tests, and only where all of
    Spark runs in this process: on a cluster executors would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _OWN[app]


def pin(df: DataFrame, what: str = "pin") -> DataFrame:
    """df as a table in the shared folder: its rows can't change any more, its lineage is cut, lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _PINNED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Delete what this application has pinned; to be called when the results made of it are written. How many tables."""
    paths = _PINNED.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)

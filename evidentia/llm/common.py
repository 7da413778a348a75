"""What the operators of this subpackage share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a folder of this machine, as in tests,
    and only where all of Spark runs in this process: on a cluster executors would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A folder to write to, under the shared one; sweep() deletes it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete all that this application's operators wrote under the shared folder; to be called when the results made of it
    are written. How many tables and archives."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named string column holds about max_bytes in each; a longer text stays whole."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lengths = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0)).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def has_letter(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def append_columns(df: DataFrame, columns: dict[str, str], text_col: str, make, max_bytes: int = 4 << 20) -> DataFrame:
    """df with further columns (name -> SQL type) that make() gives for a list of texts, as Arrow arrays. An input column
    of the name of a new one is replaced."""
    kept = df.drop(*columns)
    schema = T.StructType(kept.schema.fields + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, text_col, max_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(texts(batch, text_col))], [*batch.schema.names, *columns])

    return kept.mapInArrow(run, schema)

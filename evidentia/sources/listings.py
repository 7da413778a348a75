"""Sources: package listings, file trees, environments, machines, fact tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def fact_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A captured listing, a JSON object a line. One malformed line or one node with an error fails the whole."""
    df = spark.read.schema(schema("packages")).json(path, mode="FAILFAST")
    bad = df.filter("error is not null").select("import_path", "error").first()
    if bad:
        raise ValueError(f"{bad.import_path}: {bad.error}")
    return df


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, dir, file, content_sha of a tree. Bytes are hashed where they are read, and not kept."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "length", F.sha2("content", 256).alias("content_sha"))


def in_folder(tree: DataFrame, folder: str) -> DataFrame:
    return tree.filter(F.col("dir") == folder)


def tree_digest(states: DataFrame, root: str, skip: Column | None = None) -> Column:
    """Of listed states (path, content_sha) below a root: one fold in order of their paths."""
    rows = states.filter(F.startswith("path", F.lit(f"{root}/")))
    rows = rows if skip is None else rows.filter(~skip)
    return rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "path", "content_sha")))).cast("binary"), 256).alias("digest"))


def env_snapshot(spark: SparkSession, generation: str, env: dict[str, str | None]) -> DataFrame:
    """One pass's environment; names that repeat, are empty or can't be written are refused."""
    for k, v in env.items():
        if not k or re.search(r"[\0\r\n=]", k) or "\0" in (v or ""):
            raise ValueError(f"environment entry {k!r}")
    return spark.createDataFrame([(generation, k, v, v is not None) for k, v in sorted(env.items())], schema("env_snapshot"))


def cpu(text: Column) -> Column:
    """model, physical and logical cores of a cpuinfo text. Physical cores are the distinct pairs of physical and core id;
    without these, the logical ones."""
    blocks = F.filter(F.split(text, r"\n\n+"), lambda b: b.rlike(r"(?m)^processor"))
    field = lambda b, name: F.regexp_extract(b, rf"(?m)^{name}\s*:\s*(.*?)\s*$", 1)
    pairs = F.array_distinct(F.filter(F.transform(blocks, lambda b: F.concat_ws("/", field(b, "physical id"), field(b, "core id"))), lambda p: ~p.isin("/", "")))
    logical = F.size(blocks)
    model = F.regexp_extract(text, r"(?m)^model name\s*:\s*(.*?)\s*$", 1)
    return F.struct(model.alias("cpu_model"), F.when(F.size(pairs) > 0, F.size(pairs)).otherwise(logical).alias("physical_cores"), logical.alias("logical_cores"))


def memory_bytes(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^MemTotal:\s*(\d+) kB", 1).try_cast("bigint") * 1024


def env_lookup(env: Column, name: str) -> Column:
    return F.element_at(env, name)

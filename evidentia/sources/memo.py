"""The memo: a cache, never a record. A miss or an unreadable store is computed anew; failing to store is no failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin

ENVELOPE = 1


class Memo:
    """A table by scope and kind; rows carry the envelope's version. root=None disables it."""

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root

    def _path(self, kind: str, scope: str) -> str:
        return f"{self.root}/kind={kind}/scope={scope}"

    def load(self, kind: str, scope: str) -> DataFrame | None:
        if self.root is None:
            return None
        try:
            df = self.spark.read.parquet(self._path(kind, scope))
            return df.filter(F.col("envelope") == ENVELOPE).drop("envelope") if "envelope" in df.columns else None
        except PySparkException:
            return None

    def store(self, kind: str, scope: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Spark's committer shows all of a table or nothing."""
        if self.root is None:
            return
        try:
            df.withColumn("envelope", F.lit(ENVELOPE)).write.mode(mode).parquet(self._path(kind, scope))
        except PySparkException:
            pass

    def merge(self, kind: str, scope: str, additions: DataFrame, key: list[str]) -> DataFrame:
        """Additions replace what has their key."""
        old = self.load(kind, scope)
        both = additions if old is None else old.join(additions.select(*key), key, "left_anti").unionByName(additions)
        both = pin(both, "memo")  # it can't be read from where it is about to be written
        self.store(kind, scope, both)
        return both

    def split(self, kind: str, scope: str, wanted: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What is remembered, and the rest computed and remembered."""
        old = self.load(kind, scope)
        if old is None:
            found = pin(compute(wanted), "memo")
            self.store(kind, scope, found)
            return found
        # both pinned: storing replaces the files that they were read from
        hits = pin(wanted.join(old, key), "memo")
        rest = pin(compute(wanted.join(old.select(*key), key, "left_anti")), "memo")
        self.merge(kind, scope, rest, key)
        return hits.select(*rest.columns).unionByName(rest)


def scan_key(*parts: str) -> str:
    import hashlib

    return hashlib.sha256("\0".join(parts).encode()).hexdigest()

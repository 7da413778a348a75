"""Snapshots: two observations that agree, pinned tables of one generation, subsets, seals and batches that isolate failure."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin


class SnapshotChanged(RuntimeError):
    """The two observations differ; the message names the first table that does."""


class Sealed(RuntimeError):
    pass


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as often as they are in one and not in the other, with the side (0 or 1)."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit(0)).unionByName(b.exceptAll(a).withColumn("side", F.lit(1)))


def marks(df: DataFrame) -> tuple:
    """Count and two sums of row hashes: the same for the same rows in any order, one narrow aggregate for any size."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(df.agg(F.count("*"), *hashes).first())


def agree(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, as often. Compared by their marks; differences() names the rows."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    plain = lambda df: df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in sorted(a.columns)])
    return marks(plain(a)) == marks(plain(b))


def drift(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field: the first field, in the order given, that came, went or changed."""
    x, y = before.alias("x"), after.alias("y")
    rows = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full")
    ladder = F.when(F.col(f"x.{key}").isNull() | F.col(f"y.{key}").isNull(), "subject")
    for f in fields:
        ladder = ladder.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), f)
    return rows.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), ladder.alias("field")).filter("field is not null")


@dataclasses.dataclass
class Snapshot:
    tables: dict[str, DataFrame]
    subjects: DataFrame
    sealed: bool = False
    observations: dict[tuple[str, str], str] = dataclasses.field(default_factory=dict)

    @classmethod
    def observe(cls, read: Callable[[], dict[str, DataFrame]], subjects: DataFrame) -> Snapshot:
        """Reads twice and keeps the first, if the second is the same; pinned, so that nothing is read a third time."""
        first = {k: pin(v, k) for k, v in read().items()}
        second = read()
        for name in sorted(first):
            if not agree(first[name], second[name]):
                raise SnapshotChanged(name)
        return cls(first, pin(subjects.distinct(), "subjects"))

    def missing(self, known: DataFrame) -> DataFrame:
        """Subjects that the scan doesn't know: an error unless empty."""
        return self.subjects.join(known, self.subjects.columns, "left_anti")

    def sibling(self, subset: DataFrame) -> Snapshot:
        """A snapshot of some of the subjects, over the same tables."""
        return dataclasses.replace(self, subjects=self.subjects.join(subset, self.subjects.columns, "left_semi"), observations={})

    def attach(self, subject: tuple[str, str], manifest: str) -> None:
        """Once a subject, before the seal."""
        if self.sealed or subject in self.observations:
            raise Sealed(f"{subject} can't be attached")
        self.observations[subject] = manifest

    def validate(self, read: Callable[[], dict[str, DataFrame]]) -> None:
        """Reads again; a difference leaves the snapshot unsealed."""
        for name, now in sorted(read().items()):
            if not agree(self.tables[name], now):
                raise SnapshotChanged(name)
        self.sealed = True


def isolated(subjects: list, batch: Callable[[list], dict], fallback: str = "observation analysis unavailable: ") -> dict:
    """A batch's results; if it fails, each subject by itself, and a failure only for those that fail then."""
    try:
        return batch(subjects)
    except Exception:  # noqa: BLE001  one subject's failure must not deny another
        out = {}
        for s in subjects:
            try:
                out.update(batch([s]))
            except Exception as e:  # noqa: BLE001
                out[s] = (False, f"{fallback}{e}")
        return out


def capture(subjects: DataFrame, closures: DataFrame, guards: DataFrame, strategy: str, kind: int) -> DataFrame:
    """Recordings of subjects: a projection of a snapshot's facts. guards: one row."""
    if len(guards.limit(2).collect()) != 1:
        raise ValueError("guards are one row")
    rows = subjects.join(closures, subjects.columns, "left").crossJoin(guards)
    machine = kind == 2
    g = F.struct("toolchain", "build_config", (F.col("machine") if machine else F.lit("")).alias("machine"), (F.col("runtime_config") if machine else F.lit("")).alias("runtime_config"))
    return rows.select(F.struct(*subjects.columns).alias("subject"), F.col("hash").alias("maximal_closure"), F.col("test_variants").alias("test_variant_closure"), g.alias("guards"), F.lit(strategy).alias("dynamic_state_strategy"), F.lit(kind).alias("result_kind"))

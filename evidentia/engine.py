"""The engine: options checked once, and the three transactions over fact tables: capture, check, produce."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import digest
from .functions.digest import BUILD_ENV_KEYS, BUILD_OS_KEYS
from .operators import bracket, dynstate, verdict
from .operators.fixpoint import budget
from .operators.snapshot import Snapshot, capture
from .session import pin
from .sources.memo import Memo

Read = Callable[[], dict[str, DataFrame]]


class OptionError(ValueError):
    pass


def normalise_env(entries: Mapping[str, str] | list[str]) -> dict[str, str]:
    """NAME=value entries as a sorted mapping; malformed, repeated and unrepresentable ones are refused."""
    pairs = list(entries.items()) if isinstance(entries, Mapping) else [tuple(e.partition("=")[::2]) if "=" in e else ("", "") for e in entries]
    out: dict[str, str] = {}
    for name, value in pairs:
        if not name or "=" in name or "\0" in name + value or "\n" in name or "\r" in name:
            raise OptionError(f"malformed environment entry {name!r}")
        if name in out:
            raise OptionError(f"environment entry {name!r} is given twice")
        out[name] = value
    return dict(sorted(out.items()))


@dataclasses.dataclass(frozen=True)
class Options:
    """assume_pure: a Column over subjects, or a function of (package, symbol) asked once for each distinct subject.
    budget is wall-clock seconds for a transaction's fixpoints: beyond it an analysis is unavailable, never wrong. single_subject and package_process
    attest how the results were produced; both are part of what a memo is scoped by."""

    assume_pure: Column | Callable[[str, str], bool] | None = None
    vouches: tuple[str, ...] = ()
    single_subject: bool = False
    package_process: bool = False
    progress: Callable[[str, str], None] | None = None
    budget: float | None = None
    build_flags: tuple[str, ...] = ()
    build_inputs: tuple[str, ...] = ()
    env: Mapping[str, str] = dataclasses.field(default_factory=dict)
    producer_env: Mapping[str, str] | None = None
    defer_close: bool = False
    exclusions: tuple[str, ...] = ()
    memo_root: str | None = None

    def __post_init__(self) -> None:
        if bad := [x for x in self.build_inputs if x.startswith("-")]:
            raise OptionError(f"{bad[0]!r} is a flag; flags belong to build_flags")
        if bad := [x for x in self.build_flags if not x.startswith("-")]:
            raise OptionError(f"{bad[0]!r} is no flag")
        if bad := [x for x in self.exclusions if not x or "\0" in x or x in ("/", ".")]:
            raise OptionError(f"{bad[0]!r} can't be excluded")
        env = normalise_env(self.env)
        object.__setattr__(self, "env", env)
        if self.producer_env is not None:
            producer = normalise_env(self.producer_env)
            object.__setattr__(self, "producer_env", producer)
            for key in BUILD_ENV_KEYS + BUILD_OS_KEYS:
                if env.get(key, "") != producer.get(key, ""):
                    raise OptionError(f"{key} differs between the environments of analysis and producer")

    @property
    def scope(self) -> str:
        import hashlib

        parts = (str(self.single_subject), str(self.package_process), *self.build_flags, "|", *self.build_inputs, "|", *sorted(self.vouches))
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:32]


class Engine:
    def __init__(self, options: Options | None = None):
        self.options = options or Options()

    def _tell(self, phase: str, package: str = "") -> None:
        if self.options.progress:
            self.options.progress(phase, package)

    def memo(self, spark) -> Memo:
        return Memo(spark, self.options.memo_root)

    def remembered(self, wanted: DataFrame, kind: str, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """compute(wanted), of which what the memo holds under these options is taken from it; within the budget."""
        self._tell(kind)
        with budget(self.options.budget):
            return self.memo(wanted.sparkSession).split(kind, self.options.scope, wanted, key, compute)

    def build_config(self) -> Column:
        """Digest of the build's configuration: this engine's environment and opaque build inputs."""
        return digest.build_config(self._env(self.options.env), F.array(*map(F.lit, self.options.build_inputs)).cast("array<string>"))

    def runtime_config(self) -> Column:
        """Digest of the run's configuration, from the producer's environment where that is another."""
        return digest.runtime_config(self._env(self.options.env if self.options.producer_env is None else self.options.producer_env))

    @staticmethod
    def _env(env: Mapping[str, str]) -> Column:
        pairs = [F.lit(x) for kv in env.items() for x in kv]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def observed(self, rows: DataFrame, path: str = "path") -> DataFrame:
        """rows without those at or below this engine's exclusions."""
        if not self.options.exclusions:
            return rows
        return bracket.without_excluded(rows, rows.sparkSession.createDataFrame([(x,) for x in self.options.exclusions], "path string"), path)

    def discharges(self, candidates: DataFrame, audited: DataFrame, directives: DataFrame) -> DataFrame:
        """What this engine's vouches, audited versions and, if it attests how results are produced, directives discharge."""
        vouches = candidates.sparkSession.createDataFrame([(x,) for x in self.options.vouches], "var_key string")
        return dynstate.discharges(candidates, vouches, audited, directives, self.options.single_subject or self.options.package_process)

    def purity(self, subjects: DataFrame) -> DataFrame:
        """subjects (package, symbol, directive, external, ambiguous) with purity: who calls each of them pure."""
        ask = self.options.assume_pure
        if ask is None:
            rows = subjects.withColumn("by_caller", F.lit(False))
        elif isinstance(ask, Column):
            rows = subjects.withColumn("by_caller", F.coalesce(ask, F.lit(False)))
        else:

            @F.pandas_udf("boolean")
            def judge(packages: pd.Series, symbols: pd.Series) -> pd.Series:
                return pd.Series([bool(ask(p, s)) for p, s in zip(packages, symbols)], dtype=bool)

            asked = pin(subjects.select("package", "symbol").distinct().withColumn("by_caller", judge("package", "symbol")), "purity")
            rows = subjects.join(asked, ["package", "symbol"])
        by_directive = F.coalesce(F.col("directive") == "pure", F.lit(False))
        return rows.withColumn("purity", verdict.purity_assertion(F.col("by_caller"), by_directive, F.col("external"), F.col("ambiguous"))).drop("by_caller")

    def view(self, read: Read, subjects: DataFrame) -> Snapshot:
        self._tell("observe")
        return Snapshot.observe(read, subjects)

    def capture(self, read: Read, subjects: DataFrame, kind: int) -> DataFrame:
        """Recordings of subjects. read gives at least closures (package, symbol, hash, test_variants) and guards (one row)."""
        with budget(self.options.budget):
            view = self.view(read, subjects)
        return capture(view.subjects, view.tables["closures"], view.tables["guards"], verdict.STRATEGY, kind)

    def check(self, read: Read, recordings: DataFrame, runtime: Callable[[DataFrame], DataFrame], observed: bool = False) -> tuple[DataFrame, DataFrame]:
        """(subject, verdict, provisional) and errors. read gives current (a row a subject); runtime evaluates distinct
        manifests, and is asked twice: what moves in between is stale. With defer_close the last look at the tables is left
        to the caller and verdicts are provisional."""
        with budget(self.options.budget):
            view = self.view(read, recordings.select("subject"))
            manifests = verdict.distinct_manifests(recordings)
            self._tell("runtime")
            opening = pin(runtime(manifests), "opening")
            verdicts, errors = verdict.check(recordings, view.tables["current"], opening, observed)
            verdicts = pin(verdicts, "verdicts")
            self._tell("runtime")
            closing = runtime(manifests)
            verdicts = verdict.demote_moved(verdicts, opening, closing, recordings.select("subject", F.col("runtime_inputs").alias("manifest")))
            verdicts = pin(verdicts, "verdicts")
            if not self.options.defer_close:
                view.validate(read)
        return verdicts.withColumn("provisional", F.lit(self.options.defer_close)), errors

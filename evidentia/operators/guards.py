"""Guards: the first one, in fixed order, that differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_RESULT, MEASUREMENT = 1, 2


def differs(recorded: Column, current: Column) -> Column:
    """Missing evidence differs, even from missing evidence."""
    recorded = F.coalesce(recorded, F.lit(""))
    return (recorded == "") | (recorded != F.coalesce(current, F.lit("")))


def first_mismatch(recorded: Column, current: Column, kind: Column) -> Column:
    """Structs of toolchain, build_config, machine and runtime_config -> the name of the first that differs, or ''."""
    measured = kind == MEASUREMENT
    ladder = F.when(~F.coalesce(kind.isin(CODE_RESULT, MEASUREMENT), F.lit(False)), "kind")
    for field, name, applies in (("toolchain", "toolchain", F.lit(True)), ("build_config", "buildconfig", F.lit(True)), ("machine", "machine", measured), ("runtime_config", "runtimeconfig", measured)):
        ladder = ladder.when(applies & differs(recorded[field], current[field]), name)
    return ladder.otherwise("")


def valid_kind(kind: Column, recorded: Column) -> Column:
    """A code result carries no measurement guards; any other kind than the two is no kind."""
    absent = (F.coalesce(recorded["machine"], F.lit("")) == "") & (F.coalesce(recorded["runtime_config"], F.lit("")) == "")
    return F.coalesce((kind == MEASUREMENT) | ((kind == CODE_RESULT) & absent), F.lit(False))

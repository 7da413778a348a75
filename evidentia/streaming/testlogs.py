"""Test logs as a stream: an extension, with the batch operators' semantics a process. The state of a process is its working
directory; operations come in order of seq within a trigger and across triggers."""

from __future__ import annotations

from collections.abc import Iterator
from posixpath import isabs, join, normpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "process string, seq bigint, op string, name string, cwd string, after_chdir boolean"
STATE = "cwd string, moved boolean"


def follow(ops: DataFrame, package_dir: str) -> DataFrame:
    """ops (process, seq, op, name), streaming or not in order -> the same with cwd and after_chdir."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cwd, moved = state.get if state.exists else (package_dir, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        at, after = [], []
        for op, name in zip(rows["op"], rows["name"]):
            at.append(cwd)
            after.append(moved)
            if op == "chdir":
                cwd, moved = normpath(name if isabs(name) else join(cwd, name)), True
        state.update((cwd, moved))
        yield rows.assign(cwd=at, after_chdir=after)[["process", "seq", "op", "name", "cwd", "after_chdir"]]

    return ops.groupBy("process").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

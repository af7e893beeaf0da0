"""The iteration kernel: lineage is cut by checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Steps after which a loop over a graph gives up; a graph without cycles ends before.
MAX_STEPS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder;
    on a cluster there is none that executors could read, and this raises."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="quillgraph-"))
    return df.checkpoint()


def unfold(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_steps: int = MAX_STEPS) -> DataFrame:
    """The union of ``start``, ``step(start, 1)``, ``step`` of that, and so on, until one is empty."""
    now = cut(start)
    every = [now]
    for k in range(1, max_steps + 1):
        now = cut(step(now, k))
        if now.isEmpty():
            break
        every.append(now)
        if len(every) >= 64:  # a long union is kept as one
            first = every[0]
            for x in every[1:]:
                first = first.unionByName(x)
            every = [cut(first)]
    else:
        raise ValueError(f"no end after {max_steps} steps; is there a cycle?")
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], object], max_steps: int = MAX_STEPS) -> DataFrame:
    """``step`` applied until ``mark`` of the result doesn't change."""
    now = cut(start)
    before = mark(now)
    for _ in range(max_steps):
        now = cut(step(now))
        after = mark(now)
        if after == before:
            return now
        before = after
    raise ValueError(f"no fixpoint after {max_steps} steps")

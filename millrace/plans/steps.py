"""Named steps over a table, run in order, with a log of what each did."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators import rows
from millrace.plans import cleaning

Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Register a step under a name."""

    def add(f: Step) -> Step:
        if name in STEPS:
            raise ValueError(f"there is a step {name} already")
        STEPS[name] = f
        return f

    return add


@dataclass(frozen=True)
class Entry:
    """One step of a run: its state (done or failed), seconds of planning, columns after it, and what went wrong.

    ``seen`` counts the rows and nulls behind the step while the first action on
    what came of it runs.
    """

    step: str
    state: str
    seconds: float
    columns: int
    message: str = ""
    seen: Observation | None = None


def run(df: DataFrame, names: list[str], strict: bool = True) -> tuple[DataFrame, list[Entry]]:
    """The table after the named steps, and the log.  Steps are lazy but for the aggregates that they decide by.

    An unknown step is an error at once; a failing one ends the run, or, if not
    ``strict``, is logged and left out.  Rows and nulls are observed as the table
    passes, so the log costs no job.
    """
    unknown = [n for n in names if n not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    log = []
    for name in names:
        began = time.monotonic()
        try:
            after = STEPS[name](df)
        except Exception as e:
            log.append(Entry(name, "failed", round(time.monotonic() - began, 3), len(df.columns), str(e)[:200]))
            if strict:
                raise
            continue
        df, seen = _observed(after, f"{len(log)} {name}")
        log.append(Entry(name, "done", round(time.monotonic() - began, 3), len(df.columns), seen=seen))
    return df, log


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(f"{name} {uuid.uuid4().hex}")
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns], F.lit(0))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), nulls.alias("nulls")), seen


def log_table(spark: SparkSession, log: list[Entry], after_action: bool = False) -> DataFrame:
    """The log as rows; ``after_action`` says that the result was written or collected, so that rows and nulls are known (else null)."""
    seen = [e.seen.get if after_action and e.seen else {} for e in log]
    rows_ = [(i, e.step, e.state, e.seconds, e.columns, e.message, s.get("rows"), s.get("nulls")) for i, (e, s) in enumerate(zip(log, seen, strict=True))]
    return spark.createDataFrame(rows_, "nth int, step string, state string, seconds double, columns int, message string, rows long, nulls long")


STEPS |= {
    "drop_empty_rows": rows.drop_empty_rows,
    "drop_sparse_columns": rows.drop_sparse_columns,
    "drop_sparse_rows": rows.drop_sparse_rows,
    "drop_repeated_rows": lambda df: df.dropDuplicates(),
    "clean": lambda df: cleaning.apply(df, cleaning.decide(df)),
}

"""Breaker, quota and queue as keyed state over an event stream.

The steps are those of the batch folds, so a stream read to its end gives the batch's rows.
Within a trigger a key's events are taken in event order; across triggers in arrival order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import Breaker, Quota


def keyed_fold(events: DataFrame, key: str, order: list[str], reads: list[str], start: Callable[[], tuple], step: Callable[..., tuple], out: str, state: str) -> DataFrame:
    """One output row for each event: its own columns and those of ``out``; ``step`` gets the state and the cells that ``reads`` names; ``state`` is the DDL of a key's state."""
    names = [p.strip().split(" ")[0] for p in out.split(",")]

    def run(_key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start()
        batch = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = []
        for cells in zip(*[batch[c].tolist() for c in reads], strict=True):
            now, *new = step(now, *cells)
            rows.append(new)
        held.update(now)
        yield pd.concat([batch, pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(key).applyInPandasWithState(run, f"{schema}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, key: str, time: str, tie: str, ok: str, threshold: int = 3, cooldown: float = 300.0) -> DataFrame:
    machine = Breaker(threshold, cooldown)

    def step(state, fine, t):
        state, admitted = machine.step(tuple(state), bool(fine), float(t))
        return state, admitted, state[0], state[1]

    return keyed_fold(events, key, [time, tie], [ok, time], machine.start, step, "admitted boolean, state string, failures int", "mode string, failures int, since double")


def quota(events: DataFrame, key: str, time: str, tie: str, limit: int, hours: float) -> DataFrame:
    machine = Quota(limit, hours * 3600)

    def step(state, t):
        begun, used = state
        new, allowed = machine.step((None if begun is None or begun != begun else begun, int(used)), float(t))
        return new, allowed, new[1], new[0]

    return keyed_fold(events, key, [time, tie], [time], machine.start, step, "allowed boolean, used int, period_start double", "begun double, used int")


def retries(events: DataFrame, key: str, time: str, tie: str, kind: str, most: int = 5) -> DataFrame:
    """Queue items: ``retry`` events count up to a failure at ``most``; ``done`` and ``fail`` end an item."""

    def step(state, what):
        status, n = state
        if status in ("pending", "retrying"):
            if what == "retry":
                n += 1
                status = "failed" if n >= most else "retrying"
            elif what in ("done", "fail"):
                status = "completed" if what == "done" else "failed"
        return (status, n), status, n

    return keyed_fold(events, key, [time, tie], [kind], lambda: ("pending", 0), step, "status string, retry_count int", "status string, n int")


def outcome_windows(events: DataFrame, time: str, key: str, outcome: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of outcomes in tumbling windows, late events up to ``late`` included (an addition of ours for operations)."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key, outcome).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, outcome, "n")

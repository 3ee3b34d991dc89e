"""Order-dependent machines over event tables: breaker, limiter, quota, budget, retries.

Where a closed form exists it is a window expression.  The others are folds: events are
dealt by key, sorted inside their partition and streamed through a small Python step in
Arrow batches.  A partition holds one key's state at a time, so memory does not grow with
the events of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType


def fold_sorted(events: DataFrame, key: str, order: list[str], reads: list[str], start: Callable[[], object], step: Callable[..., tuple], out: str) -> DataFrame:
    """One output row for each event: ``step(state, *cells)`` gives the next state and the row's new columns.

    ``reads`` names the cells, ``out`` is the DDL of the new columns, which follow the
    event's own.  Events without a key are one key's events.
    """
    names = [p.strip().split(" ")[0] for p in out.split(",")]
    kinds = events.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            rows = []
            for now, *cells in zip(frame.pop("_fold_key").tolist(), *[frame[c].tolist() for c in reads], strict=True):
                if now != current:
                    current, state = now, start()
                state, *new = step(state, *cells)
                rows.append(new)
            extra = pd.DataFrame(rows, columns=names, index=frame.index)
            yield pd.concat([frame, extra], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    # as text, a null key is equal to itself in Python too
    keyed = events.withColumn("_fold_key", F.to_json(F.struct(key)))
    return keyed.repartition("_fold_key").sortWithinPartitions("_fold_key", *order).mapInPandas(run, f"{schema}, {out}")


@dataclass
class Breaker:
    """A circuit: closed, open after ``threshold`` failures, half open for one probe after the cooldown."""

    threshold: int = 3
    cooldown: float = 300.0

    def start(self) -> tuple[str, int, float]:
        return ("closed", 0, 0.0)

    def step(self, state, ok: bool, t: float) -> tuple[tuple[str, int, float], bool]:
        """(next state, was the request let through)."""
        mode, failures, since = state
        if mode == "open":
            if t - since < self.cooldown:
                return state, False
            mode = "half_open"
        if ok:
            return ("closed", 0, 0.0), True
        failures += 1
        if mode == "half_open" or failures >= self.threshold:
            return ("open", failures, t), True
        return (mode, failures, since), True


def breaker(events: DataFrame, key: str, time: str, tie: str, ok: str, threshold: int = 3, cooldown: float = 300.0) -> DataFrame:
    """Adds ``admitted``, ``state`` and ``failures`` after each request (``time`` in seconds)."""
    machine = Breaker(threshold, cooldown)

    def step(state, fine, t):
        state, admitted = machine.step(state, bool(fine), float(t))
        return state, admitted, state[0], state[1]

    return fold_sorted(events, key, [time, tie], [ok, time], machine.start, step, "admitted boolean, state string, failures int")


def limiter(events: DataFrame, key: str, time: str, tie: str, interval: float) -> DataFrame:
    """Adds ``started`` and ``waited``: requests of a key start at least ``interval`` apart.

    The n-th start is the largest of every earlier arrival plus the intervals since, so it
    is a running maximum and needs no fold.  Time is cut into ranges that are summed up
    apart; what earlier ranges bring, their number of requests and their latest lead, is one
    row a range, so a key's requests never meet in one task.
    """
    cut = events.withColumn("_range", ranges(events, time))
    w = Window.partitionBy(key, "_range").orderBy(time, tie)
    cut = cut.withColumn("_n", F.row_number().over(w).cast("double"))
    # a lead is an arrival less the intervals before it, counted from the range's first request
    cut = cut.withColumn("_lead", F.col(time) - F.col("_n") * interval)
    parts = cut.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_c"), F.max("_lead").alias("_m"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)).cast("double"))
    parts = parts.withColumn("_far", F.max(F.col("_m") - F.col("_before") * interval).over(before)).select("_k", "_r", "_before", "_far")
    out = cut.join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    here = F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_before") * interval
    lead = F.greatest(here, F.col("_far"))
    out = out.withColumn("started", lead + (F.col("_before") + F.col("_n")) * interval)
    return out.withColumn("waited", F.col("started") - F.col(time)).select(*events.columns, "started", "waited")


@dataclass
class Quota:
    """Downloads in a period that begins with its first use; a clock that went back starts anew."""

    limit: int
    seconds: float

    def start(self) -> tuple[float | None, int]:
        return (None, 0)

    def step(self, state, t: float) -> tuple[tuple[float | None, int], bool]:
        begun, used = state
        if begun is None or t - begun < 0 or t - begun >= self.seconds:
            begun, used = t, 0
        if used >= self.limit:
            return (begun, used), False
        return (begun, used + 1), True


def quota(events: DataFrame, key: str, time: str, tie: str, limit: int, hours: float) -> DataFrame:
    """Adds ``allowed``, ``used`` and ``period_start`` to download requests in time order."""
    machine = Quota(limit, hours * 3600)

    def step(state, t):
        state, allowed = machine.step(state, float(t))
        return state, allowed, state[1], state[0]

    return fold_sorted(events, key, [time, tie], [time], machine.start, step, "allowed boolean, used int, period_start double")


def budget(items: DataFrame, work: str, kind: str, size: str, order: str, per_work: dict[str, int | None], total: dict[str, int | None] | None = None, stop: bool = False) -> DataFrame:
    """Adds ``admitted``: greedy admission in ``order``, where what is refused uses nothing up.

    Limits are bytes by kind, null for none; ``order`` is unique.  Items of no size use
    nothing and are admitted.  Per-work limits alone are a fold of each work.  Where a
    refusal by a total only skips the item, kinds whose items could exceed it are folded
    kind by kind, with one number kept for each work of the kind.  With ``stop`` the first
    refusal by a total ends the run: every later item of any kind is refused.  Until then
    the works decide alone, so running sums of what they admit find that item.
    """
    total = {k: v for k, v in (total or {}).items() if v is not None}

    def by_work(state, what, n):
        used, limit, n = state.get(what, 0), per_work.get(what), int(n)
        ok = n <= 0 or limit is None or used + n <= limit
        return state | {what: used + max(n, 0)} if ok else state, ok

    def works(rows: DataFrame) -> DataFrame:
        return fold_sorted(rows, work, [order], [kind, size], dict, by_work, "admitted boolean")

    if stop and total:
        limit = F.create_map(*[F.lit(x) for k, v in total.items() for x in (k, v)])[F.col(kind)]
        alone = works(items)
        before = running_sum(alone, [kind], order, F.when(F.col("admitted"), F.greatest(F.col(size), F.lit(0))).otherwise(0), "_before")
        trip = before.filter((F.col(size) > 0) & (F.col("_before") + F.col(size) > limit)).agg(F.min(order).alias("_trip")).first()["_trip"]
        return alone if trip is None else alone.withColumn("admitted", F.col("admitted") & ((F.col(order) < F.lit(trip)) | (F.col(size) <= 0)))
    sums = {r[kind]: r["s"] for r in items.filter(F.col(kind).isin(list(total))).groupBy(kind).agg(F.sum(size).alias("s")).collect()} if total else {}
    tight = [k for k, v in total.items() if (sums.get(k) or 0) > v]

    def by_kind(state, where, what, n):
        held, used = state
        n, limit, most = int(n), per_work.get(what), total[what]
        mine = held.get(where, 0)
        ok = n <= 0 or (used + n <= most and (limit is None or mine + n <= limit))
        if ok and n > 0:
            held[where] = mine + n
            used += n
        return (held, used), ok

    if not tight:
        return works(items)
    loose = works(items.filter(~F.coalesce(F.col(kind).isin(tight), F.lit(False))))
    return loose.unionByName(fold_sorted(items.filter(F.col(kind).isin(tight)), kind, [order], [work, kind, size], lambda: ({}, 0), by_kind, "admitted boolean"))


def used_bytes(items: DataFrame, work: str, kind: str, size: str) -> DataFrame:
    """(work, kind, bytes): what each work holds of each kind."""
    return items.groupBy(work, kind).agg(F.sum(size).alias("bytes"))


#: Ranges of the order that a long running sum is cut into.
RANGES = 128


def ranges(rows: DataFrame, order: str, parts: int = RANGES) -> Column:
    """The number of the order's range that a row lies in; the bounds are approximate quantiles, a few numbers.

    Rows of equal order lie in one range, so a tie-breaking column need not be looked at.
    An order that is no number, date or time is one range.
    """
    if not isinstance(rows.schema[order].dataType, (NumericType, DatetimeType)):
        return F.lit(0)
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    return F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order)))) if cuts else F.lit(0)


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows before this one; ``order`` is unique.

    The order is cut into ranges that are summed apart, so a key's rows never meet in one task.
    """
    cut = rows.withColumns({"_range": ranges(rows, order), "_value": value})
    parts = cut.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    here = F.coalesce(F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_here", here).join(parts, same).withColumn(out, F.col("_earlier") + F.col("_here")).select(*rows.columns, out)


def islands(events: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, run, length, first, last): maximal runs of bad events; ``order`` ends with a unique column.

    A run's number is that of the good events before it: those of earlier ranges of the
    order, summed apart, and those of its own range, so a key's events never meet in one task.
    """
    cut = events.withColumns({"_range": ranges(events, order[0]), "_bad": bad})
    parts = cut.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.count_if(~F.coalesce("_bad", F.lit(False))).alias("_good"))
    earlier = F.sum("_good").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_k", "_r", F.coalesce(earlier, F.lit(0)).alias("_before"))
    w = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w)
    marked = cut.withColumn("_here", here).filter("_bad").join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    runs = marked.groupBy(key, (F.col("_before") + F.col("_here")).alias("run")).agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return runs.select(key, "run", "length", "first", "last")


def early_stop(pages: DataFrame, key: str, order: str, placeholder: str, failed: str, most_placeholders: int = 3, most_failures: int = 5) -> DataFrame:
    """Pages fetched before a run of placeholders or of failures ends the work (the last of the run included)."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def in_run(flag: str) -> Column:
        resets = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(upto)
        return F.struct(F.col(key), resets)

    out = pages.withColumn("_a", in_run(placeholder)).withColumn("_b", in_run(failed))
    out = out.withColumn("_na", F.sum(F.col(placeholder).cast("int")).over(Window.partitionBy("_a").orderBy(order)))
    out = out.withColumn("_nb", F.sum(F.col(failed).cast("int")).over(Window.partitionBy("_b").orderBy(order)))
    ends = (F.col("_na") >= most_placeholders) | (F.col("_nb") >= most_failures)
    end = F.min(F.when(ends, F.col(order))).over(Window.partitionBy(key))
    return out.withColumn("_end", end).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_a", "_b", "_na", "_nb", "_end")


def number_files(saved: DataFrame, work: str, stem: str, slug: str, extension: str, order: str, longest: int = 50) -> DataFrame:
    """Adds ``seq`` and ``filename`` to kept files: images count from 001, of other types the second on gets a number."""
    from ..functions.payload import IMAGE_EXTENSIONS

    short = F.when(F.length(stem) > longest, F.rtrim(F.left(F.col(stem), F.lit(longest)), F.lit("_"))).otherwise(F.col(stem))
    kind = F.when(F.col(extension).isin(IMAGE_EXTENSIONS), "image").otherwise(F.coalesce(F.nullif(F.ltrim(F.col(extension), F.lit(".")), F.lit("")), F.lit("bin")))
    out = saved.withColumns({"_stem": short, "_kind": kind})
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy(work, "_stem", slug, "_kind").orderBy(order)))
    base = F.concat_ws("_", "_stem", slug)
    name = F.when(F.col("_kind") == "image", F.concat(base, F.lit("_image_"), F.lpad(F.col("seq").cast("string"), 3, "0"))).when(F.col("seq") > 1, F.concat_ws("_", base, F.col("seq").cast("string"))).otherwise(base)
    return out.withColumn("filename", F.concat(name, F.col(extension))).drop("_stem", "_kind")


# Response codes that count against a provider, and those that are the caller's own fault.
REFUSALS, CALLER_FAULTS = [401, 403], [400, 404, 410, 422]


def attempt_outcome(code: Column) -> Column:
    """What a response code means to the breaker: ``failure``, ``success``, or ``retry``."""
    return F.when(code.isin(REFUSALS), "failure").when(code.isin(CALLER_FAULTS) | code.between(200, 399), "success").when((code == 429) | code.between(500, 599) | code.isNull(), "retry").otherwise("failure")

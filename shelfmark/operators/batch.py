"""A batch of works from the table to the ledgers: what is pending, what is chosen, what came of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import ledger as lg
from .downloads import run_plan
from .select import stated

OK, SOME = 0, 1


def exit_code(failed: Column) -> Column:
    """0 where nothing failed, else 1; deferred works are tried again and count as no failure."""
    return F.when(F.coalesce(failed, F.lit(0)) > 0, SOME).otherwise(OK)


def summary(outcomes: DataFrame, command: str, dry_run: bool = False, label: str = "outcome") -> DataFrame:
    """(summary): one line of JSON that counts the outcomes of a run; without outcomes all are 0."""
    counts = outcomes.agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col(label) == k).alias(n) for k, n in (("success", "succeeded"), ("failed", "failed"), ("deferred", "deferred"), ("skipped", "skipped"))])
    return counts.select(F.to_json(F.struct(F.lit(command).alias("command"), "*", F.lit(dry_run).alias("dry_run"))).alias("summary"))


@dataclass
class Batch:
    """What a batch came to: an outcome a work, the works table after it, and the summary line."""

    outcomes: DataFrame
    works: DataFrame
    summary: DataFrame


def pending_rows(works: DataFrame, mode: str = "all", entries: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The rows that a batch takes: valid ones by mode, then the wanted entries, then the first ``limit`` in file order."""
    rows = lg.pending(lg.parsed_works(works), mode)
    if entries is not None:
        rows = lg.only_entries(rows, entries)
    return lg.first_rows(rows, limit) if limit is not None else rows


def run(works: DataFrame, selected: DataFrame, fetch: Callable[[dict], str], now: Column, audit: DataFrame | None = None, dry_run: bool = False, mode: str = "all", entries: DataFrame | None = None, limit: int | None = None, resume: str = "skip_completed") -> Batch:
    """Works through a works table.

    ``selected``: entry_id, provider_key, source_id, item_url (null provider: nothing was
    found).  A row with a direct link needs no selection.  ``fetch`` gets a task and returns
    ``success``, ``failed`` or ``deferred``; what it raises is its own failure, never the
    batch's.  Finished works of ``audit`` are skipped by the resume mode; a dry run fetches
    nothing and changes nothing.
    """
    rows = pending_rows(works, mode, entries, limit)
    left = lg.without_finished(rows, audit, resume) if audit is not None else rows
    chosen = selected.select(F.col("entry_id").alias("_e"), "provider_key", "source_id", "item_url")
    tasks = left.join(chosen, F.col("entry_id") == F.col("_e"), "left").drop("_e").select("entry_id", F.when(F.col("direct").isNotNull(), "direct_iiif").otherwise(F.col("provider_key")).alias("provider"), F.coalesce("direct", "item_url").alias("url"), "source_id")
    found = stated(F.col("provider"))
    skipped = rows.join(left.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("url"))
    if dry_run:
        made = tasks.select("entry_id", F.when(found, "dry_run").otherwise("no_match").alias("outcome"), "provider", "url")
    else:

        def attempt(task: dict) -> str:
            try:
                return fetch(task)
            except Exception:
                return "failed"

        ran = run_plan(tasks.filter(found), "provider", attempt, "outcome string")
        # without a selection there is nothing to fetch, which is a failure
        made = ran.select("entry_id", "outcome", "provider", "url").unionByName(tasks.filter(~found).select("entry_id", F.lit("failed").alias("outcome"), "provider", "url"))
    # fetching happens once, whatever is read of its outcome
    outcomes = kept(made.unionByName(skipped), "batch")
    events = outcomes.filter(F.col("outcome").isin("success", "failed", "deferred")).select("entry_id", now.alias("ts"), F.lit(0).alias("seq"), "outcome", F.col("url").alias("item_url"), "provider")
    return Batch(outcomes, works if dry_run else lg.apply_status(works, events), summary(outcomes, "batch", dry_run))

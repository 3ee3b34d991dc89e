"""The deferred-download queue and provider quotas as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import instant, reset_time, seconds_until
from .ledger import blank

ACTIVE = ["pending", "retrying"]
SAME = ["entry_id", "provider_key", "source_id"]
MAX_RETRIES, KEEP_DAYS = 5, 7


def add_deferred(queue: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The queue after new items: an active item of the same entry, provider and source takes the new reset time.

    Items without an entry_id are never merged.  Of new items alike the last one's time
    stays; ``new`` has the queue's columns and an arrival ``order``.
    """
    columns = queue.columns
    loose = new.filter(blank(F.col("entry_id"))).select(*columns)
    keyed = new.filter(~blank(F.col("entry_id")))
    w = Window.partitionBy(*[F.coalesce(F.col(c), F.lit("")) for c in SAME])
    keyed = keyed.withColumn("_last", F.last("reset_time").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_n", F.row_number().over(w.orderBy(order)))
    first = keyed.filter("_n = 1").withColumn("reset_time", F.col("_last")).drop("_n", "_last")
    old = queue.withColumn("_on", F.col("status").isin(ACTIVE) & ~blank(F.col("entry_id")))
    changes = first.select(*[F.col(c).alias(f"_{c}") for c in SAME], F.col("reset_time").alias("_reset"))
    same = F.col("_on")
    for c in SAME:
        same = same & F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.coalesce(F.col(f"_{c}"), F.lit("")))
    updated = old.join(changes, same, "left").withColumn("reset_time", F.coalesce("_reset", "reset_time")).select(*columns)
    held = old.filter("_on").select(*[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in SAME]).distinct()
    added = first
    for c in SAME:
        added = added.withColumn(f"_{c}", F.coalesce(F.col(c), F.lit("")))
    added = added.join(held, [f"_{c}" for c in SAME], "left_anti").select(*columns)
    return updated.unionByName(added).unionByName(loose)


def retried(status: Column, retries: Column, most: int = MAX_RETRIES) -> tuple[Column, Column]:
    """(status, retry_count) of an item after one more attempt was begun."""
    n = retries + 1
    return F.when(n >= most, "failed").otherwise("retrying"), n


def ready(now: Column) -> Column:
    """Items to retry: active, and their reset time is past, absent or unreadable."""
    at = instant(F.col("reset_time"))
    return F.col("status").isin(ACTIVE) & (at.isNull() | (at <= now))


def outdated(now: Column, days: int = KEEP_DAYS) -> Column:
    """Finished items deferred longer ago than ``days``, or at no known time."""
    at = instant(F.col("deferred_at"))
    return F.col("status").isin("completed", "failed") & (at.isNull() | (at < now - F.make_dt_interval(days=F.lit(days))))


def first_waiting(queue: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first active items, as they are shown to a reader."""
    return queue.filter(F.col("status").isin(ACTIVE)).orderBy(order).limit(most)


def by_provider(queue: DataFrame) -> DataFrame:
    """(provider_key, n, waiting): items and active items of each provider."""
    return queue.groupBy("provider_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(ACTIVE)).alias("waiting"))


def counts(queue: DataFrame) -> DataFrame:
    """(status, n, retries): items and recorded retries by status."""
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").alias("retries"))


def next_ready(queue: DataFrame) -> DataFrame:
    """One row: the earliest reset time of active items."""
    return queue.filter(F.col("status").isin(ACTIVE)).agg(F.min(instant(F.col("reset_time"))).alias("next_ready"))


def owned(queue: DataFrame, works: DataFrame) -> DataFrame:
    """Items whose entry and exact title stand in the works table."""
    return queue.join(works.select("entry_id", F.col("short_title").alias("title")).distinct(), ["entry_id", "title"], "left_semi")


def quota_view(quotas: DataFrame, now: Column) -> DataFrame:
    """Adds ``expired``, ``exhausted``, ``reset_at`` and ``seconds_left`` to quota records.

    A period is over after its hours or when the clock went back; an unreadable start counts as over.
    """
    begun = instant(F.col("period_start"))
    until = reset_time(begun, F.col("reset_hours"))
    expired = begun.isNull() | (now >= until) | (now < begun)
    out = quotas.withColumn("expired", expired)
    out = out.withColumn("exhausted", ~F.col("expired") & (F.col("downloads_used") >= F.col("daily_limit")))
    return out.withColumn("reset_at", until).withColumn("seconds_left", F.when(F.col("exhausted"), seconds_until(until, now)).otherwise(0))


def exhausted_providers(quotas: DataFrame, now: Column) -> DataFrame:
    """(provider_key, reset_at, is_next): providers out of quota; the one that resets first is marked."""
    out = quota_view(quotas, now).filter("exhausted").select("provider_key", "reset_at")
    first = out.agg(F.min_by("provider_key", F.struct("reset_at", "provider_key")).alias("_first"))
    return out.join(first, F.col("provider_key") == F.col("_first"), "left").withColumn("is_next", F.col("_first").isNotNull()).drop("_first")


def retry_at(quota_reset: Column, now: Column, hours: int = 1) -> Column:
    """When to try again: the quota's reset if known, else some hours from now."""
    return F.coalesce(quota_reset, now + F.make_dt_interval(hours=F.lit(hours)))


def as_candidate(queue: DataFrame) -> DataFrame:
    """Queue items as candidate records again."""
    none = F.expr("cast(array() as array<string>)")
    return queue.select("entry_id", "provider_key", F.col("title"), F.when(blank(F.col("creator")), none).otherwise(F.array("creator")).alias("creators"), "source_id")

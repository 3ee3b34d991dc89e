"""Works table and ledgers: status parsing, pending rows, updates, upserts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import is_manifest_url
from ..functions.text import strip

COMPLETED, FAILED, DEFERRED, PENDING = "completed", "failed", "deferred", "pending"
# Spellings of a yes and of a no.
YES, NO = ["true", "1", "yes", "y", "wahr"], ["false", "0", "no", "n", "falsch"]


def parse_status(cell: Column) -> Column:
    """The status that a cell's text stands for; what is not understood is pending."""
    s = F.lower(strip(cell.cast("string")))
    # a cast to double would take a type letter at the end
    n = F.when(~s.rlike("[df]$"), s.try_cast("double"))
    return F.when(s.isin(YES), COMPLETED).when(s.isin(NO), FAILED).when(s == DEFERRED, DEFERRED).when(n == 1, COMPLETED).when(n == 0, FAILED).otherwise(PENDING)


def blank(text: Column) -> Column:
    return strip(F.coalesce(text.cast("string"), F.lit(""))) == ""


def direct_link(configured: Column, standard: Column, general: Column | None = None) -> Column:
    """The first of the columns that holds a manifest URL, trimmed."""
    columns = [configured, standard] + ([general] if general is not None else [])
    return F.coalesce(*[F.when(is_manifest_url(c), strip(c)) for c in columns])


def parsed_works(works: DataFrame, link: Column | None = None) -> DataFrame:
    """Rows that can be processed: an entry_id, and a title or a direct link.  Adds ``direct``."""
    link = direct_link(F.col("direct_link"), F.col("direct_link"), F.col("link")) if link is None else link
    out = works.withColumn("direct", link)
    return out.filter(~blank(F.col("entry_id")) & (~blank(F.col("short_title")) | F.col("direct").isNotNull()))


def pending(works: DataFrame, mode: str = "all") -> DataFrame:
    """Rows to work on.  ``all``: whatever is not completed; ``new``: pending; ``failed``: failed."""
    status = parse_status(F.col("retrievable"))
    if mode == "all":
        return works.filter(status != COMPLETED)
    return works.filter(status == {"new": PENDING, "failed": FAILED}[mode])


def completed_entries(works: DataFrame) -> DataFrame:
    """(entry_id): the completed entries, once each."""
    return works.filter(parse_status(F.col("retrievable")) == COMPLETED).select("entry_id").distinct()


def only_entries(works: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose entry_id is wanted."""
    return works.join(wanted.select("entry_id"), "entry_id", "left_semi")


def first_rows(works: DataFrame, n: int, order: str = "_row_ix") -> DataFrame:
    """The first ``n`` rows in file order."""
    if n < 0:
        raise ValueError("a limit cannot be negative")
    return works.orderBy(order).limit(n)


def without_finished(works: DataFrame, audit: DataFrame, mode: str = "skip_completed") -> DataFrame:
    """Rows left to do under a resume mode.

    ``audit``: entry_id, status, n_objects.  ``skip_completed`` drops completed works,
    ``skip_if_has_objects`` works with objects, ``resume_from_csv`` rows that the table itself
    calls completed, ``reprocess_all`` none.
    """
    if mode == "reprocess_all":
        return works
    if mode == "resume_from_csv":
        return pending(works)
    done = audit.filter("n_objects > 0") if mode == "skip_if_has_objects" else audit.filter(F.col("status") == COMPLETED)
    return works.join(done.select("entry_id"), "entry_id", "left_anti")


def status_counts(works: DataFrame) -> DataFrame:
    """One row: total and the rows of each status."""
    s = parse_status(F.col("retrievable")) if "retrievable" in works.columns else F.lit(PENDING)
    return works.select(s.alias("s")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("s") == k).alias(k) for k in (COMPLETED, FAILED, DEFERRED, PENDING)])


def latest(events: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last event of each key; ``order`` ends with a column that breaks ties."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    carried = [c for c in events.columns if c not in key]
    last = F.max_by(F.struct(*carried), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)]))
    return events.groupBy(*key).agg(last.alias("_e")).select(*key, *[F.col(f"_e.{c}").alias(c) for c in carried])


def apply_status(works: DataFrame, events: DataFrame) -> DataFrame:
    """The works table after status events (entry_id, ts, seq, outcome, item_url, provider).

    Every row of an entry takes its last event: success sets the link and the provider,
    failure and deferral set the status alone.  Ledger columns that the table lacks are added.
    """
    for c in ("retrievable", "link", "download_provider", "download_timestamp"):
        if c not in works.columns:
            works = works.withColumn(c, F.lit(None).cast("string"))
    last = latest(events, ["entry_id"], ["ts", "seq"]).select("entry_id", F.struct("ts", "outcome", "item_url", "provider").alias("_e"))
    ok = F.col("_e.outcome") == "success"
    seen = F.col("_e").isNotNull()
    cell = F.when(ok, "True").when(F.col("_e.outcome") == "failed", "False").when(F.col("_e.outcome") == "deferred", DEFERRED)
    stamp = F.date_format("_e.ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return works.join(last, "entry_id", "left").withColumns({
        "retrievable": F.when(seen, cell).otherwise(F.col("retrievable")),
        "link": F.when(ok, F.col("_e.item_url")).otherwise(F.col("link")),
        "download_provider": F.when(ok, F.col("_e.provider")).otherwise(F.col("download_provider")),
        "download_timestamp": F.when(ok, stamp).otherwise(F.col("download_timestamp")),
    }).drop("_e")


def upsert(ledger: DataFrame, rows: DataFrame, key: list[str], order: str, append_if_blank: str | None = None) -> DataFrame:
    """The ledger after the rows: the last row of a key replaces the ledger's first row of that key, others are added.

    Null and empty key cells are the same.  Rows whose ``append_if_blank`` cell is blank are
    always added.  Both tables have an ``order`` column of arrival.
    """
    columns = ledger.columns
    keyed = [F.coalesce(F.col(k), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    free = blank(F.col(append_if_blank)) if append_if_blank else F.lit(False)
    fresh = rows.select("*", *keyed).withColumn("_free", free)
    new = latest(fresh.filter("not _free").drop("_free"), names, [order]).select(*names, F.struct(*[c for c in columns if c != order]).alias("_new"))
    place = Window.partitionBy(*names).orderBy(order)
    old = ledger.select("*", *keyed).withColumn("_first", F.row_number().over(place) == 1)
    old_side = old.select(*[F.col(n).alias(f"o{n}") for n in names], F.struct(*columns).alias("_old"), "_first")
    match = F.col("_first") & (F.lit(not append_if_blank) | ~blank(F.col(f"_old.{append_if_blank}")) if append_if_blank else F.lit(True))
    for n in names:
        match = match & (F.col(n) == F.col(f"o{n}"))
    both = old_side.join(new, match, "full_outer")
    out = both.select(*[(F.coalesce(F.col(f"_old.{c}"), F.lit(None)) if c == order else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))).alias(c) for c in columns])
    return out.unionByName(fresh.filter("_free").select(*columns)) if append_if_blank else out


def merge_present(ledger: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells that an update names overwrite, null as empty text; cells it does not name stay.

    ``updates`` has the key and ``cells``, a map from column to value.
    """
    out = ledger.join(updates.select(key, "cells"), key, "left")
    named = {c: F.when(F.array_contains(F.map_keys("cells"), c), F.coalesce(F.element_at("cells", c), F.lit(""))).otherwise(F.col(c)) for c in columns}
    return out.withColumns(named).drop("cells")


def outcome_counts(outcomes: DataFrame, label: str = "outcome") -> DataFrame:
    """One row: works by outcome of a batch; partial results count nowhere and stay pending."""
    return outcomes.agg(*[F.count_if(F.col(label) == k).alias(k) for k in ("success", "failed", "deferred", "skipped", "no_match")])


def parallel_failed(scheduled: Column, deferred: Column, direct: Column, no_match: Column) -> Column:
    """Failures of a parallel run: the scheduler's without the deferred ones, plus direct and unmatched ones."""
    return F.greatest(F.lit(0), scheduled - deferred) + direct + no_match


def unfinished_labels(left_out: DataFrame, done: DataFrame) -> DataFrame:
    """Works without a task: ``skipped`` where an audit row says completed, else ``no_match``."""
    seen = done.select(F.col("entry_id").alias("_d"))
    return left_out.join(seen, F.col("entry_id") == F.col("_d"), "left").withColumn("label", F.when(F.col("_d").isNotNull(), "skipped").otherwise("no_match")).drop("_d")

"""Audit documents and index rows of processed works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import work_directory, work_id
from ..schema import INDEX_COLUMNS
from .ledger import blank
from .select import ARRIVAL


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def candidate_entry() -> Column:
    """A candidate as its audit entry; scores are a nested record."""
    scores = F.struct("title_score", "creator_score", "year_penalty", "total")
    return F.struct("provider", "provider_key", "title", "creators", "date", "source_id", "item_url", "iiif_manifest", scores.alias("scores"))


def work_documents(works: DataFrame, candidates: DataFrame, selected: DataFrame, key: str, now: Column) -> DataFrame:
    """(key, document): one JSON document per work: input, status, candidates in arrival order, selected record.

    ``works``: key, entry_id, short_title, main_author.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*ARRIVAL, candidate_entry().alias("c")))), lambda x: x["c"])
    found = candidates.groupBy(key).agg(listed.alias("candidates"))
    best = selected.select(key, candidate_entry().alias("selected"))
    out = works.join(found, key, "left").join(best, key, "left")
    status = F.when(F.col("selected").isNotNull(), "pending").when(F.col("candidates").isNotNull(), "no_match").otherwise("no_candidates")
    given = F.struct("entry_id", F.col("short_title").alias("title"), F.col("main_author").alias("creator"))
    document = F.struct(given.alias("input"), iso(now).alias("created_at"), iso(now).alias("updated_at"), status.alias("status"), "candidates", "selected")
    return out.select(key, F.to_json(document).alias("document"))


def index_rows(works: DataFrame, selected: DataFrame, key: str, now: Column, status: str = "completed") -> DataFrame:
    """Index ledger rows of works with their selected record; an empty item URL takes the record's own."""
    best = selected.select(key, "provider", "provider_key", "source_id", F.col("item_url").alias("_url"))
    out = works.join(best, key, "left")
    url = F.coalesce(F.nullif(F.col("item_url"), F.lit("")) if "item_url" in works.columns else F.lit(None).cast("string"), F.col("_url"))
    folder = work_directory(F.col("entry_id"), F.col("short_title"))
    cells = {
        "work_id": work_id(F.col("short_title"), F.col("main_author")), "entry_id": F.col("entry_id"), "work_dir": folder, "title": F.col("short_title"),
        "creator": F.col("main_author"), "selected_provider": F.col("provider"), "selected_provider_key": F.col("provider_key"), "selected_source_id": F.col("source_id"),
        "selected_dir": F.concat(folder, F.lit("/objects")), "work_json": F.concat(folder, F.lit("/work.json")), "item_url": url, "status": F.lit(status), "created_at": iso(now), "updated_at": iso(now),
    }
    return out.select(*[F.coalesce(cells[c].cast("string"), F.lit("")).alias(c) for c in INDEX_COLUMNS])


def changed_status(documents: DataFrame, status: Column, now: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Documents with a new status, time of change, and further top-level cells; all other cells keep their values and kinds.

    What is no JSON object stays as it is.
    """
    new = {"status": status, "updated_at": iso(now)} | (extra or {})
    old = F.map_filter(F.try_variant_get(F.try_parse_json("document"), "$", "map<string,variant>"), lambda k, v: ~k.isin(*new))
    cells = [x for name, value in new.items() for x in (F.lit(name), F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})), "$.v", "variant"))]
    return documents.withColumn("document", F.coalesce(F.to_json(F.map_concat(old, F.create_map(*cells)), {"ignoreNullFields": "false"}), F.col("document")))


def rendering_provenance(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rendering records by URL, the last one of a URL stays."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    cells = [c for c in both.columns if c not in (key, "url", "_late")]
    last = both.groupBy(key, "url").agg(F.max_by(F.struct(*cells), F.struct("_late", order)).alias("_r"))
    return last.select(key, "url", *[F.col(f"_r.{c}").alias(c) for c in cells])


def write_documents(documents: DataFrame, path: str, by: str | None = None) -> None:
    """Writes documents as JSON text lines, in folders of ``by`` if given."""
    out = documents.select(*([by] if by else []), F.col("document").alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def read_documents(spark, path: str) -> DataFrame:
    """(path, document): stored documents; what is no JSON object becomes an empty one."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    good = F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT"))
    return rows.select("path", F.when(good, F.col("value")).otherwise("{}").alias("document"))


def completeness_marker(expected: Column, saved: Column) -> Column:
    return F.when(saved == 0, "failed").when(saved < expected, "partial").otherwise("completed")


def unfinished(documents: DataFrame) -> DataFrame:
    """Documents without an entry_id in their input."""
    return documents.filter(blank(F.get_json_object("document", "$.input.entry_id")))

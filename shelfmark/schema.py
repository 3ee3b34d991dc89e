"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

WORK_COLUMNS = ("entry_id", "short_title", "main_author", "year", "direct_link", "retrievable", "link", "download_provider", "download_timestamp")
#: Columns of the index ledger, all text; (work_id, entry_id) is its key.
INDEX_COLUMNS = (
    "work_id", "entry_id", "work_dir", "title", "creator", "selected_provider", "selected_provider_key",
    "selected_source_id", "selected_dir", "work_json", "item_url", "status", "created_at", "updated_at",
)


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


WORKS = strings(*WORK_COLUMNS)
INDEX = strings(*INDEX_COLUMNS)
CANDIDATES = StructType([
    StructField("work_key", StringType()),
    StructField("provider_key", StringType()),
    StructField("provider", StringType()),
    StructField("title", StringType()),
    StructField("creators", ArrayType(StringType())),
    StructField("date", StringType()),
    StructField("source_id", StringType()),
    StructField("iiif_manifest", StringType()),
    StructField("item_url", StringType()),
    StructField("thumbnail_url", StringType()),
    StructField("provider_ix", IntegerType()),
    StructField("hit_ix", IntegerType()),
])
QUOTA = StructType([
    StructField("provider_key", StringType()),
    StructField("daily_limit", IntegerType()),
    StructField("reset_hours", DoubleType()),
    StructField("downloads_used", IntegerType()),
    StructField("period_start", StringType()),
    StructField("exhausted_at", StringType()),
])
PAGE_SOURCES = StructType([StructField("kind", StringType()), StructField("url", StringType()), StructField("ord", LongType())])

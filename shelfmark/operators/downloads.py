"""Download plans: which URLs a selected record leads to, in which order and under which caps.

A plan is data.  Fetching it is the caller's edge: ``run_plan`` hands each provider's tasks
to a function inside the executors, provider by provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import NATIVE_PROVIDERS
from .iiif import first_pages, image_url_ladder, page_sources, renderings

# Image URLs tried before a service's info.json is read, renderings tried for one manifest.
SPECULATIVE, RENDERING_TRIES = 3, 10
PLAN = ["work", "stage", "ord", "attempt", "url", "name"]


def manifest_plan(manifests: DataFrame, work: str, body: str, prefix: Column, max_pages: int | None = None, max_renderings: int = 1, renderings_first: bool = True) -> DataFrame:
    """(work, stage, ord, attempt, url, name): renderings, then pages with their ladder of image URLs."""
    found = renderings(manifests, work, body)
    docs = found.filter(F.col("ord") <= RENDERING_TRIES).select(F.col(work).alias("work"), F.lit(0 if renderings_first else 1).alias("stage"), "ord", F.lit(1).alias("attempt"), "url", F.concat(F.lit("rendering_"), F.col("ord")).alias("name"))
    pages = first_pages(page_sources(manifests, work, body), max_pages)
    stem = prefix if prefix is not None else F.lit("page")
    urls = F.when(F.col("kind") == "direct", F.array("url")).otherwise(F.slice(image_url_ladder(F.col("url")), 1, SPECULATIVE))
    name = F.concat(stem, F.lit("_p"), F.lpad(F.col("ord").cast("string"), 5, "0"))
    images = pages.select(F.col(work).alias("work"), F.lit(1 if renderings_first else 0).alias("stage"), "ord", F.posexplode(urls).alias("attempt", "url"), name.alias("name")).withColumn("attempt", F.col("attempt") + 1)
    return docs.select(*PLAN).unionByName(images.select(*PLAN))


def reachable(selected: DataFrame) -> DataFrame:
    """Adds ``route``: how a selected record is fetched: its manifest, the provider's own way, or not at all."""
    manifest = F.coalesce(F.col("iiif_manifest"), F.lit("")) != ""
    return selected.withColumn("route", F.when(manifest, "manifest").when(F.col("provider_key").isin(NATIVE_PROVIDERS), "native").when(F.col("source_id").isNotNull(), "identifier").otherwise("none"))


def link_attempts(links: DataFrame, key: str, kind: str, order: str, most: int = 5) -> DataFrame:
    """The first links of each record, direct before slow before mirror."""
    place = F.array_position(F.array(*map(F.lit, ("direct", "slow", "mirror"))), F.col(kind))
    w = Window.partitionBy(key).orderBy(place, order)
    return links.filter(place > 0).withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= most)


def run_plan(tasks: DataFrame, provider: str, fetch: Callable[[dict], object], out: str = "ok boolean") -> DataFrame:
    """(task columns, ``out``): runs ``fetch`` for each task; a provider's tasks run one after the other.

    The tasks of one provider are streamed through one partition, as its servers want them
    one at a time; no task list is held in memory.
    """

    columns, name = tasks.columns, out.split(" ")[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = zip(*[frame[c].tolist() for c in columns], strict=True)
            yield frame.assign(**{name: [fetch(dict(zip(columns, t, strict=True))) for t in cells]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields)
    return tasks.repartition(provider).mapInPandas(run, f"{schema}, {out}")


def outcomes(attempts: DataFrame, work: str) -> DataFrame:
    """(work, status, pages_expected, pages_saved): a page is saved if any of its attempts was."""
    pages = attempts.groupBy(work, "ord").agg(F.bool_or("ok").alias("saved"))
    counted = pages.groupBy(work).agg(F.count(F.lit(1)).alias("pages_expected"), F.count_if("saved").alias("pages_saved"))
    return counted.withColumn("status", F.when(F.col("pages_saved") == 0, "failed").when(F.col("pages_saved") < F.col("pages_expected"), "partial").otherwise("completed"))

"""Scoring, gating, ranking and selecting candidate records.

Arrival order is data: ``provider_ix`` and ``hit_ix`` number providers and their hits, and
every ranking ends with them, so ties resolve the same way on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import extract_year, year_penalty
from ..functions.similarity import creator_score, with_title_score

# Points for a manifest and for an item page; rank of an unlisted provider.
MANIFEST_POINTS, PAGE_POINTS, UNLISTED = 3.0, 0.5, 9999
ARRIVAL = ("provider_ix", "hit_ix")


def stated(text: Column) -> Column:
    """Does a text say anything?  Empty counts as absent."""
    return F.coalesce(text, F.lit("")) != ""


def boost(manifest: Column, page: Column) -> Column:
    return F.when(stated(manifest), MANIFEST_POINTS).otherwise(0.0) + F.when(stated(page), PAGE_POINTS).otherwise(0.0)


def total_score(title: Column, creator: Column, weight: float, boosts: Column, penalty: Column) -> Column:
    return title + F.lit(min(1.0, max(0.0, weight))) * creator + boosts - penalty


def with_scores(pairs: DataFrame, creator_weight: float = 0.2, tolerance: int = 0, method: str = "token_set", least: int | None = None) -> DataFrame:
    """Adds title_score, creator_score, year_penalty and total to (query_title, query_creator, query_year, candidate …).

    ``least`` leaves pairs that cannot pass the gate with their lower bound, which saves the
    exact comparison; leave it unset where every score is reported.
    """
    scored = with_title_score(pairs, "query_title", "title", "title_score", method, least)
    scored = scored.withColumn("creator_score", creator_score(F.col("query_creator"), F.col("creators")))
    scored = scored.withColumn("year_penalty", year_penalty(extract_year(F.col("date")), F.col("query_year"), tolerance))
    total = total_score(F.col("title_score"), F.col("creator_score"), creator_weight, boost(F.col("iiif_manifest"), F.col("item_url")), F.col("year_penalty"))
    return scored.withColumn("total", total)


def with_priority(candidates: DataFrame, providers: DataFrame) -> DataFrame:
    """Adds the provider's priority; unlisted providers come last.  ``providers``: provider_key, priority."""
    dim = providers.select(F.col("provider_key").alias("_p"), "priority")
    return candidates.join(dim, F.col("provider_key") == F.col("_p"), "left").drop("_p").withColumn("priority", F.coalesce("priority", F.lit(UNLISTED)))


def provider_ranks(names: DataFrame, hierarchy: list[str], order: str) -> DataFrame:
    """(provider_key, priority): each provider once, those of the hierarchy first and in its order, the others by ``order``.

    The window sorts one short row for each distinct name.
    """
    listed = {p: i for i, p in enumerate(dict.fromkeys(hierarchy))}
    place = F.lit(UNLISTED)
    for p, i in listed.items():
        place = F.when(F.col("provider_key") == p, i).otherwise(place)
    once = names.groupBy("provider_key").agg(F.min(order).alias("_o")).filter("provider_key is not null")
    w = Window.orderBy(place, "_o", "provider_key")
    return once.select("provider_key", (F.row_number().over(w) - 1).alias("priority"))


def known_only(selected: DataFrame, providers: DataFrame) -> DataFrame:
    """Selected records of a known provider; a work whose best candidate is of another has no selection."""
    return selected.join(providers.select("provider_key"), "provider_key", "left_semi")


def cap_hits(candidates: DataFrame, work: str, most: int | str) -> DataFrame:
    """The first hits of each work and provider; ``most`` is a number or a column of the row's own limit."""
    w = Window.partitionBy(work, "provider_key").orderBy("hit_ix")
    limit = F.lit(most) if isinstance(most, int) else F.col(most)
    return candidates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def ranking(work: str):
    """Best first: provider priority before score, then arrival."""
    return Window.partitionBy(work).orderBy(F.col("priority"), F.col("total").desc(), *ARRIVAL)


def ranked(candidates: DataFrame, work: str, gate: Column) -> DataFrame:
    """Candidates that pass the gate, with their rank in the work from 1."""
    return candidates.filter(gate).withColumn("rank", F.row_number().over(ranking(work)))


def select_best(candidates: DataFrame, work: str, gate: Column) -> DataFrame:
    """The first candidate of each work."""
    return ranked(candidates, work, gate).filter("rank = 1").drop("rank")


def first_hit(candidates: DataFrame, work: str, gate: Column) -> DataFrame:
    """Sequential search: hits of the providers up to the first with a passing hit, and the chosen one.

    Adds ``selected``: of the stopping provider's passing hits the best total, first on ties.
    """
    passing = F.when(gate, F.col("provider_ix"))
    seen = candidates.withColumn("_stop", F.min(passing).over(Window.partitionBy(work))).filter(F.col("_stop").isNull() | (F.col("provider_ix") <= F.col("_stop")))
    mine = gate & (F.col("provider_ix") == F.col("_stop"))
    place = F.row_number().over(Window.partitionBy(work).orderBy(F.when(mine, 0).otherwise(1), F.col("total").desc(), "hit_ix"))
    return seen.withColumn("selected", mine & (place == 1)).withColumn("selected", F.coalesce("selected", F.lit(False))).drop("_stop")


def fallbacks(candidates: DataFrame, selected: DataFrame, work: str, gate: Column, providers: DataFrame) -> DataFrame:
    """Candidates to try after the selected one, in rank order: passing, of a known provider, other than the selected source."""
    chosen = selected.select(F.col(work).alias("_w"), F.col("provider_key").alias("_pk"), F.col("source_id").alias("_sid"))
    known = providers.select("provider_key")
    rest = candidates.filter(gate).join(known, "provider_key", "left_semi").join(chosen, F.col(work) == F.col("_w"), "left")
    same = F.col("provider_key").eqNullSafe(F.col("_pk")) & F.col("source_id").eqNullSafe(F.col("_sid"))
    rest = rest.filter(~(same & F.col("_w").isNotNull())).drop("_w", "_pk", "_sid")
    return rest.withColumn("rank", F.row_number().over(ranking(work)))


def first_success(attempts: DataFrame, work: str, ok: str) -> DataFrame:
    """(work, rank, outcome): the first attempt that succeeded, or none."""
    return attempts.groupBy(work).agg(F.min(F.when(F.col(ok), F.col("rank"))).alias("rank")).withColumn("outcome", F.when(F.col("rank").isNull(), "failed").otherwise("completed"))


def display_top(candidates: DataFrame, work: str, most: int = 10) -> DataFrame:
    """The candidates shown to a reader: best title score first, arrival on ties, and the number left out."""
    place = F.row_number().over(Window.partitionBy(work).orderBy(F.col("title_score").desc(), *ARRIVAL))
    # counted apart, so that the rank limit can cut rows before the sort
    counts = candidates.groupBy(F.col(work).alias("_w")).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))
    shown = candidates.withColumn("place", place).filter(F.col("place") <= most)
    return shown.join(counts, F.col(work) == F.col("_w")).drop("_w")


def best_titles(titles: DataFrame, key: str, query: str, title: str, order: str | list[str]) -> DataFrame:
    """(key, title, token_score, simple_score): of each record's titles the one that fits best by either score.

    The first of equals by the columns of ``order`` counts, then the smaller title; titles that score nothing are never chosen.
    """
    order = [order] if isinstance(order, str) else order
    scored = with_title_score(with_title_score(titles, query, title, "_token"), query, title, "_simple", "simple")
    scored = scored.withColumn("_both", F.greatest("_token", "_simple")).filter("_both > 0")
    best = F.min_by(F.struct(F.col(title).alias("title"), F.col("_token").alias("token_score"), F.col("_simple").alias("simple_score")), F.struct(-F.col("_both"), *order, title))
    return scored.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def search_result(works: DataFrame, candidates: DataFrame, gate: Column, work: str) -> DataFrame:
    """(work, status, selected …, n_candidates, candidates): one row per work.

    ``status`` is match, no_match (hits but none passes) or no_candidates.  The selected
    record is that of ``select_best``, found in the same aggregation that lists the hits.
    """
    order = F.struct("priority", -F.col("total"), *ARRIVAL)
    best = F.min_by(F.struct("provider_key", "source_id", "total"), F.when(gate, order))
    listed = F.array_sort(F.collect_list(F.struct("provider_ix", "hit_ix", "provider_key", "source_id", "title", "title_score", "total")))
    found = candidates.groupBy(work).agg(F.count(F.lit(1)).alias("n_candidates"), best.alias("_best"), F.count_if(gate).alias("_passing"), listed.alias("candidates"))
    out = works.select(work).join(found, work, "left")
    status = F.when(F.col("_passing") > 0, "match").when(F.col("n_candidates").isNull(), "no_candidates").otherwise("no_match")
    return out.select(
        work,
        status.alias("status"),
        F.col("_best.provider_key").alias("selected_provider"),
        F.col("_best.source_id").alias("selected_source_id"),
        F.col("_best.total").alias("selected_total"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        "candidates",
    )

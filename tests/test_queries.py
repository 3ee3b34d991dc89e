"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest

import __spark_entry__
from shelfmark.plans import load
from tests.compare import compare, connect
from tests.conftest import SF

REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, duck, name):
    if name in REGISTRY.SQL:
        compare(spark, duck, SF, name, REGISTRY.QUERIES[name], REGISTRY.SQL[name])
    else:
        # all columns are computed; test_matching_rows restates them
        assert len(REGISTRY.QUERIES[name](spark, SF).collect()) > 0


def test_entry_and_contract(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:2] == ["entry_id", "status"] and {r.status for r in out.collect()} <= {"match", "no_match", "no_candidates"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_twin_take_every_hit(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "the old mill by the river. More.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("They saw the old mill by the river "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("token_set_ratio", "simple_ratio", "best_creator_score"):
        assert REGISTRY.QUERIES[name](spark, str(tmp_path)).count() == 12, name
    # the search's own setting still caps, and the SQL twin does
    assert REGISTRY.QUERIES["search_work"](spark, str(tmp_path)).first().n_candidates == 5
    assert REGISTRY.QUERIES["token_overlap"](spark, str(tmp_path)).count() == 5


def test_ordered_providers_takes_every_source(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(10_050).select(F.concat(F.lit("src"), "id").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    assert REGISTRY.QUERIES["ordered_providers"](spark, str(tmp_path)).count() == 10_050


def test_many_wanted_runs_meet_by_hash(spark):
    """The plan for more wanted runs than are broadcast finds the same hits."""
    from shelfmark.plans import views

    few, many = (views.hits(spark, SF, broadcast_runs=n) for n in (10**6, 0))
    assert few.count() > 0 and sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect()))

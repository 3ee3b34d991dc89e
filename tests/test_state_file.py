"""The state file: any size and layout, cut in blocks, written as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import state as ss


@pytest.fixture
def tiny_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def load(spark, path):
    how, quotas, items = ss.load_state(spark, str(path))
    rows = items.orderBy("ord").collect()
    assert len({r.ord for r in rows}) == len(rows)
    return how, {r.provider_key: r.daily_limit for r in quotas.collect()}, [(r.id, r.title, json.loads(r.raw_data)) for r in rows]


TITLES = ["plain", 'a "quoted" } one', "back\\slash\\", '\\" {[', "]}, {", "long " * 60, "ünï   \U0001f600", ""]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}, {"indent": 1, "ensure_ascii": False}])
def test_layouts_and_blocks(spark, tmp_path, tiny_blocks, style):
    pick = random.Random(7)
    items = [{"id": str(i), "title": pick.choice(TITLES), "raw_data": pick.choice([{}, {"x": [[1], {"y": "}"}]}, {"s": '"'}])} for i in range(40)]
    mixed = [5, "}{", None, [1, [2]], *items[:20], "x", True, *items[20:], -1.5, [{}]]
    doc = {"odd [": [[], {}, "]"], "version": "1 } 0", "quotas": {f'k"{i}}}': {"daily_limit": i} for i in range(9)}, "deferred_items": mixed, "more": {"a": {"b": [1, 2]}, "c": 3}}
    (tmp_path / "s.json").write_text(json.dumps(doc, **style) + "\n" * (len(style) % 2), encoding="utf-8")
    how, quotas, got = load(spark, tmp_path / "s.json")
    assert how == "loaded" and quotas == {k: v["daily_limit"] for k, v in doc["quotas"].items()}
    assert got == [(x["id"], x["title"], x["raw_data"]) for x in items]


GOOD = '{"quotas":{"a":{"daily_limit":1}},"deferred_items":[{"id":"1"},{"id":"2"}]}'


def test_what_is_no_object_is_corrupt(spark, tmp_path):
    broken = [GOOD[:-1], GOOD[:-2], GOOD + "}", GOOD + "x", GOOD.replace(',{"id":"2"}', ' {"id":"2"}'), GOOD.replace(']}', ",]}"), GOOD.replace("[{", "[,{"), GOOD.replace('"2"}', '"2"]'), GOOD.replace('"1"}', '"1}'), GOOD.replace('{"id":"2"}', "{id:2}"), "", " ", "5", "[{}]", GOOD[:-1] + ',"z":[1,]}', "}{"]
    for n, text in enumerate(broken):
        path = tmp_path / f"b{n}.json"
        path.write_text(text)
        assert load(spark, path) == ("corrupt", {}, []), text
        assert (tmp_path / f"b{n}.corrupt").read_text() == text
    for n, text in enumerate([GOOD, f" {GOOD}\n\n", GOOD.replace(",", " ,\n\t")]):
        (tmp_path / f"g{n}.json").write_text(text)
        assert load(spark, tmp_path / f"g{n}.json") == ("loaded", {"a": 1}, [("1", "Unknown", {}), ("2", "Unknown", {})])
    for n, text in enumerate(['{}', '{"quotas":[],"deferred_items":{}}', '{"quotas":{},"deferred_items":[]}', '{"quotas":null,"deferred_items":"[{"}']):
        (tmp_path / f"e{n}.json").write_text(text)
        assert load(spark, tmp_path / f"e{n}.json") == ("loaded", {}, [])


def test_the_last_of_equal_keys_counts(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"quotas":{"a":{"daily_limit":1},"b":{"daily_limit":2},"a":{"daily_limit":3}},"deferred_items":[{"id":"x"}],"deferred_items":[{"id":"y"}]}')
    assert load(spark, tmp_path / "s.json") == ("loaded", {"a": 3, "b": 2}, [("y", "Unknown", {})])


def test_a_document_beyond_one_value(spark, tmp_path):
    """A document of more bytes than one variant holds is neither corrupt nor cut."""
    title = "t" * 1_000_000
    with (tmp_path / "s.json").open("w") as f:
        f.write('{"quotas":{"a":{}},"deferred_items":[')
        f.writelines(f'{"," * (i > 0)}{{"id":"{i}","title":"{title}"}}' for i in range(140))
        f.write("]}")
    how, quotas, items = ss.load_state(spark, str(tmp_path / "s.json"))
    assert how == "loaded" and [r.id for r in items.orderBy("ord").select("id").collect()] == [str(i) for i in range(140)]


def test_written_and_read(spark, tmp_path):
    none = F.lit(None)
    items = spark.range(500).repartition(7).select(
        *[F.when(F.col("id") % 3 == 0, f'{c} "x"\n').cast("string").alias(c) if k == "string" else F.col("id").cast("int").alias(c) for c, (k, _) in ss.ITEM_FIELDS.items()],
        (500 - F.col("id")).alias("place"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"n":'), "id", F.lit("}"))).alias("raw_data"),
    )
    quotas = spark.createDataFrame([("b", 1, 24, 0, None, None), ('a"', 2, 24, 1, "p", "e"), ("b", 3, 24, 0, None, None)], "provider_key string, daily_limit int, reset_hours int, downloads_used int, period_start string, exhausted_at string")
    path = f"{tmp_path}/s.json"
    ss.write_state(spark, path, quotas, items, "place", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    doc = json.loads((tmp_path / "s.json").read_text())
    assert doc["version"] == "1.0" and doc["last_updated"] == "2024-01-15T12:00:00Z"
    assert list(doc["quotas"]) == ['a"', "b"] and doc["quotas"]["b"] == {"provider_key": "b", "daily_limit": 3, "reset_hours": 24, "downloads_used": 0, "period_start": None, "exhausted_at": None}
    assert [x["retry_count"] for x in doc["deferred_items"]] == list(range(499, -1, -1))
    assert doc["deferred_items"][0]["raw_data"] == {} and doc["deferred_items"][1]["raw_data"] == {"n": 498} and doc["deferred_items"][1]["title"] == 'title "x"\n'
    how, back_quotas, back = ss.load_state(spark, path)
    assert back_quotas.count() == 2 and back.count() == 500
    # over the file that it was read from, and with nothing left
    ss.write_state(spark, path, back_quotas, back.filter(none.isNotNull()), "ord", F.current_timestamp())
    assert json.loads((tmp_path / "s.json").read_text())["deferred_items"] == []


def test_no_record_passes_through_the_driver(spark, tmp_path, monkeypatch):
    """The state queries neither collect the document nor hold it in one row."""
    from shelfmark.plans import files

    monkeypatch.setattr(ss, "save_state", lambda *_: pytest.fail("the document is one text"))
    spark.range(3000).select(F.col("id").alias("event_id"), F.lit("2024-01-15 12:00:00").cast("timestamp").alias("ts"), (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    assert files.state_items(spark, str(tmp_path)).count() == 3000 and files.state_quotas(spark, str(tmp_path)).count() == 9

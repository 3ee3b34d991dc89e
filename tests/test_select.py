"""Selection semantics on hand-made candidates, settings, records and manifests."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark import cli, config
from shelfmark.operators import iiif
from shelfmark.operators import select as sel
from shelfmark.sources import records as rec

ROWS = [  # work, provider_ix, hit_ix, provider_key, source_id, title_score, total
    ("1", 0, 0, "weak", "a", 60, 60.0), ("1", 1, 0, "pref", "b", 55, 55.0), ("1", 1, 1, "pref", "c", 55, 55.0), ("1", 2, 0, "other", "d", 100, 103.5),
    ("2", 0, 0, "weak", "e", 10, 10.0), ("3", 1, 0, "pref", None, 90, 90.0), ("3", 1, 1, "pref", None, 80, 80.0),
]


@pytest.fixture(scope="module")
def scored(spark):
    dim = spark.createDataFrame([("pref", 0), ("weak", 1)], "provider_key string, priority int")
    df = spark.createDataFrame(ROWS, "w string, provider_ix int, hit_ix int, provider_key string, source_id string, title_score int, total double")
    return sel.with_priority(df.withColumn("title", F.lit("t")), dim), dim



def test_priority_before_score_and_ties_by_arrival(scored):
    got = {r.w: (r.provider_key, r.source_id) for r in sel.select_best(scored[0], "w", F.col("title_score") >= 50).collect()}
    assert got == {"1": ("pref", "b"), "3": ("pref", None)}


def test_first_hit_stops_at_the_first_passing_provider(scored):
    got = sorted((r.w, r.source_id or "", r.selected) for r in sel.first_hit(scored[0], "w", F.col("title_score") >= 58).collect())
    assert got == [("1", "a", True), ("2", "e", False), ("3", "", False), ("3", "", True)]


def test_fallbacks_leave_out_the_selected_source(scored):
    best = sel.select_best(scored[0], "w", F.col("title_score") >= 50)
    got = [(r.w, r.source_id, r["rank"]) for r in sel.fallbacks(scored[0], best, "w", F.col("title_score") >= 50, scored[1]).orderBy("w", "rank").collect()]
    assert got == [("1", "c", 1), ("1", "a", 2)]  # work 3: both records are the same unnamed source


def test_result_statuses(spark, scored):
    works = spark.createDataFrame([("1",), ("2",), ("4",)], "w string")
    got = {r.w: (r.status, r.selected_source_id) for r in sel.search_result(works, scored[0], F.col("title_score") >= 50, "w").collect()}
    assert got == {"1": ("match", "b"), "2": ("no_match", None), "4": ("no_candidates", None)}


def test_settings():
    c = {"selection": {"min_title_score": "45", "search_timeout_seconds": 60}, "provider_settings": {"gallica": {"min_title_score": 50}, "p": {"min_title_score": "high", "search_timeout_seconds": 0}}}
    assert config.min_title_score(c, "bnf_gallica", 85) == 50 and config.min_title_score(c, "p", 85) == 45 and config.min_title_score({}, None, 85) == 85
    assert config.search_timeout(c, "p", 9) is None and config.search_timeout(c, "q", 9) == 60 and config.search_timeout({}, "q", 9) == 9
    assert config.provider_order(["a", "b", "c"], ["c", "x", "a"]) == ["c", "a", "b"]
    assert config.override_providers(["a"], ["a", "b", "c"], None, "b, z", "a") == (["b"], ["z"]) and config.override_providers(["a"], ["a", "b"], "b")[0] == ["b"]
    assert config.network_policy({"provider_settings": {"p": {"delay_ms": 9}}}, "p")["delay_ms"] == 9
    with pytest.raises(FileNotFoundError):
        config.load_config("/nowhere.json")


def test_one_bad_canvas_loses_no_other(spark):
    bodies = [
        {"sequences": {"canvases": [{"images": []}, 7, {"images": [{"resource": {"service": [{"x": 1}, {"@id": "s"}]}}]}, {"images": [{"resource": {"@type": "oa:Choice", "item": [{"@id": "d"}]}}]}]}},
        {"items": [{"items": [{"items": [{"body": {"id": "https://i/x/full/max/0/d.jpg"}}]}]}, {"items": []}, {"items": [{"items": [{"body": [{"id": "e"}]}]}]}]},
        {"sequences": [{"canvases": "none"}, {"canvases": [{"images": [{"resource": {"@id": "k"}}]}]}], "items": [{"items": [{"items": [{"body": {"id": "k"}}]}]}]},
    ]
    m = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "{"), (10, None)], "r int, body string")
    got = {}
    for x in iiif.page_sources(m, "r", "body").orderBy("r", "ord").collect():
        got.setdefault(x.r, []).append((x.kind, x.url))
    assert got == {0: [("service", "s"), ("direct", "d")], 1: [("service", "https://i/x"), ("direct", "e")], 2: [("direct", "k")]}


def test_whitelist_narrows_renderings(spark):
    m = spark.createDataFrame([(1, '{"rendering":[{"id":"a.pdf","format":"application/pdf"},{"id":"b.epub","format":"APPLICATION/EPUB+ZIP"},{"id":"c.pdf","type":"Text"},{"id":"d","format":"text/html"},{"id":"a.pdf"}]}')], "k int, b string")
    assert [r.url for r in iiif.renderings(m, "k", "b").orderBy("ord").collect()] == ["a.pdf", "c.pdf", "b.epub"]
    assert [r.url for r in iiif.renderings(m, "k", "b", ("application/epub+zip",)).orderBy("ord").collect()] == ["b.epub", "c.pdf", "a.pdf"]  # without a type the suffix admits, and ranks last


def test_malformed_records_do_not_hide_others(spark):
    body = json.dumps({"response": {"docs": [3, {"title": "T", "identifier": "x", "creator": "Ibsen, H."}, None, {"title": None}]}})
    r = spark.createDataFrame([(1, body), (2, "<xml/>"), (3, None)], "c int, b string")
    got = rec.json_records(r, "internet_archive", "c", "b").orderBy("hit_ix").collect()
    assert [(x.title, x.creators, x.source_id) for x in got] == [("T", ["Ibsen, H."], "x"), ("", [], None)]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "w.csv").write_text("entry_id,short_title,main_author,retrievable\n1,Voyage au centre,Verne,\n2,Nothing alike,X,\n3,Done,X,True\n")
    hits = [(e, "ia", 0, 0, "Voyage au centre de la terre", ["Verne"], None, "s1", None, None) for e in ("1", "E0001")]
    spark.createDataFrame(hits, "entry_id string, provider_key string, provider_ix int, hit_ix int, title string, creators array<string>, date string, source_id string, iiif_manifest string, item_url string").write.parquet(str(tmp_path / "h"))
    w, h = str(tmp_path / "w.csv"), str(tmp_path / "h")
    assert cli.main(["search", w, h, "--entry-ids", "1"]) == 0 and "match\tia\ts1" in capsys.readouterr().out
    assert cli.main(["search", w, h]) == 1
    assert cli.main(["search", "--title", "Voyage au centre", "--json", h]) == 0 and '"status":"match"' in capsys.readouterr().out
    assert cli.main(["pending", w, "--limit", "1"]) == 0 and capsys.readouterr().out.strip() == "1\tVoyage au centre"
    assert cli.main(["status", w]) == 0 and "completed: 1" in capsys.readouterr().out
    assert cli.main(["identify", "bsb123"]) == 0 and "bsb123/manifest" in capsys.readouterr().out
    assert cli.main(["identify", "zzz"]) == 1 and cli.main(["providers"]) == 0 and cli.main(["pending", w, "--limit", "-1"]) == 2 and cli.main(["search", h]) == 2 and cli.main(["status", "/nowhere.csv"]) == 2

"""Works tables and ledgers: statuses, CSV round trips, updates, upserts, queue, verification."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import audit, downloads, queue, verify
from shelfmark.operators import ledger as lg
from shelfmark.sources import works as wk


@pytest.mark.parametrize("cell,status", [
    (None, "pending"), ("", "pending"), ("True", "completed"), (" yes ", "completed"), ("Y", "completed"), ("1", "completed"), ("1.0", "completed"), ("WAHR", "completed"), ("FALSE", "failed"),
    ("0.0", "failed"), ("n", "failed"), ("Falsch", "failed"), ("Deferred", "deferred"), ("2", "pending"), ("maybe", "pending"), ("nan", "pending"),
])
def test_status(spark, cell, status):
    assert spark.createDataFrame([(cell,)], "c string").select(lg.parse_status(F.col("c"))).first()[0] == status


def test_csv_round_trip(spark, tmp_path):
    text = '﻿entry_id,short_title,retrievable,Year,note\r\n00123,"A ""quoted"", title",WAHR,1651,x\r\n00124,"two\r\nlines",,,\r\n'
    (tmp_path / "w.csv").write_bytes(text.encode())
    df = wk.read_works(spark, str(tmp_path / "w.csv"))
    rows = df.orderBy("_row_ix").collect()
    assert [r.entry_id for r in rows] == ["00123", "00124"] and rows[0].short_title == 'A "quoted", title' and "two" in rows[1].short_title and rows[0].note == "x"
    assert rows[0].link is None and df.select(wk.year_column(df)).first()[0] == "1651"
    assert wk.line_end(spark, str(tmp_path / "w.csv")) == "\r\n"
    wk.write_csv(df, str(tmp_path / "out"), one_file=True)
    back = wk.read_works(spark, str(tmp_path / "out"))
    assert [r.short_title.replace("\r\n", "\n") for r in back.orderBy("_row_ix").collect()] == [r.short_title.replace("\r\n", "\n") for r in rows]
    assert lg.status_counts(df).first().asDict() == {"total": 2, "completed": 1, "failed": 0, "deferred": 0, "pending": 1}


def test_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title\nx\n")
    (tmp_path / "b.csv").write_text("entry_id,other\n1,x\n")
    (tmp_path / "c.csv").write_text("entry_id,direct_link\n1,https://x/manifest\n")
    for name in "ab":
        with pytest.raises(ValueError):
            wk.read_works(spark, str(tmp_path / f"{name}.csv"))
    assert lg.parsed_works(wk.read_works(spark, str(tmp_path / "c.csv"))).first().direct == "https://x/manifest"


def test_updates_touch_every_row_of_an_entry(spark):
    works = spark.createDataFrame([("1", "a", None, None, None, None), ("1", "b", "x", "l", None, None), ("2", "c", None, None, None, None)], "entry_id string, short_title string, retrievable string, link string, download_provider string, download_timestamp string")
    events = spark.createDataFrame([("1", "2024-01-01 00:00:00", 1, "failed", None, None), ("1", "2024-01-02 00:00:00", 2, "success", "u", "p")], "entry_id string, ts string, seq int, outcome string, item_url string, provider string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.short_title: (r.retrievable, r.link, r.download_provider, r.download_timestamp) for r in lg.apply_status(works, events).collect()}
    assert got["a"] == got["b"] == ("True", "u", "p", "2024-01-02T00:00:00Z") and got["c"] == (None, None, None, None)


def test_upsert(spark):
    old = spark.createDataFrame([("w1", None, "old", 1), ("w1", "", "second", 2), ("", "e", "blank", 3)], "work_id string, entry_id string, status string, ix int")
    new = spark.createDataFrame([("w1", "", "a", 1), ("w1", "", "b", 2), ("", "e", "c", 3), ("w2", "e", "d", 4)], "work_id string, entry_id string, status string, ix int")
    got = sorted((r.work_id, r.status) for r in lg.upsert(old, new, ["work_id", "entry_id"], "ix", append_if_blank="work_id").collect())
    assert got == [("", "blank"), ("", "c"), ("w1", "b"), ("w1", "second"), ("w2", "d")]


def test_queue_add_and_ready(spark):
    schema = "id string, entry_id string, provider_key string, source_id string, status string, reset_time string"
    old = spark.createDataFrame([("1", "e", "p", None, "pending", "t0"), ("2", "e", "q", None, "failed", "t0")], schema)
    new = spark.createDataFrame([("3", "e", "p", None, "pending", "t1", 1), ("4", "e", "q", None, "pending", "t2", 2), ("5", "", "p", None, "pending", "t3", 3), ("6", "", "p", None, "pending", "t4", 4)], schema + ", n int")
    got = sorted((r.id, r.reset_time) for r in queue.add_deferred(old, new, "n").collect())
    assert got == [("1", "t1"), ("2", "t0"), ("4", "t2"), ("5", "t3"), ("6", "t4")]
    q = spark.createDataFrame([("1", "pending", "2024-01-01T00:00:00"), ("2", "retrying", "bad"), ("3", "pending", "2030-01-01"), ("4", "completed", None)], "id string, status string, reset_time string")
    assert sorted(r.id for r in q.filter(queue.ready(F.lit("2024-06-01").cast("timestamp"))).collect()) == ["1", "2"]


def test_verify_and_files(spark, tmp_path):
    for name, data in (("a/objects/x.pdf", b"%PDF-1.7"), ("a/objects/y.part", b"z"), ("b/objects/x.pdf", b"<HTML>"), ("c/objects/x.jpg", b""), ("a/work.json", b"{}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = verify.stored_files(verify.work_folders(spark, str(tmp_path))).withColumn("k", F.regexp_extract("work_dir", "([^/]+)$", 1))
    works = spark.createDataFrame([("a", 1), ("b", None), ("c", None), ("d", None)], "k string, pages_expected int")
    got = {r.k: r.reason for r in verify.verdicts(works, files, "k").collect()}
    assert got == {"a": None, "b": "PDF contains HTML", "c": "empty file", "d": "no objects"}
    assert verify.verdicts(works.withColumn("pages_expected", F.lit(2)), files, "k").filter("k = 'a'").first().reason == "missing pages"


def test_audit_documents_and_index_rows(spark):
    works = spark.createDataFrame([("1", "E1", "Bønder", "Ibsen")], "k string, entry_id string, short_title string, main_author string")
    cands = spark.createDataFrame([("1", 1, 0, "P", "p", "late", ["c"], None, "s2", "", "m", 50, 0, 0.0, 53.0), ("1", 0, 0, "P", "p", "early", ["c"], None, "s1", "u", None, 90, 0, 0.0, 90.5)], "k string, provider_ix int, hit_ix int, provider string, provider_key string, title string, creators array<string>, date string, source_id string, item_url string, iiif_manifest string, title_score int, creator_score int, year_penalty double, total double")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    docs = audit.work_documents(works, cands, cands.filter("provider_ix = 0"), "k", now)
    d = docs.select(F.get_json_object("document", "$.candidates[0].title").alias("t"), F.get_json_object("document", "$.selected.source_id").alias("s"), F.get_json_object("document", "$.status").alias("st")).first()
    assert tuple(d) == ("early", "s1", "pending")
    row = audit.index_rows(works, cands.filter("provider_ix = 0"), "k", now).first()
    assert row.work_dir == "e_1_bonder" and row.item_url == "u" and row.created_at == "2024-01-01T00:00:00Z" and len(row.work_id) == 10
    new = audit.changed_status(docs, F.lit("completed"), now).select(F.get_json_object("document", "$.status")).first()[0]
    assert new == "completed"


def test_plans(spark):
    body = '{"rendering":{"@id":"https://r/a.pdf"},"sequences":[{"canvases":[{"images":[{"resource":{"service":{"@id":"https://iiif/1/"}}}]},{"images":[{"resource":{"@id":"https://img/2.jpg"}}]},{"images":[{"resource":{"@id":"https://img/3.jpg"}}]}]}]}'
    m = spark.createDataFrame([("w", body)], "w string, body string")
    plan = downloads.manifest_plan(m, "w", "body", F.lit("x"), max_pages=2)
    got = [(r.stage, r.ord, r.attempt, r.url) for r in plan.orderBy("stage", "ord", "attempt").collect()]
    assert got == [(0, 1, 1, "https://r/a.pdf")] + [(1, 1, i + 1, f"https://iiif/1/full/{t}/0/default.jpg") for i, t in enumerate(("full", "max", "pct:100"))] + [(1, 2, 1, "https://img/2.jpg")]
    ran = downloads.run_plan(plan.filter("stage = 1"), "work", lambda t: "max" in t["url"])
    assert downloads.outcomes(ran, "work").first().asDict() == {"work": "w", "pages_expected": 2, "pages_saved": 1, "status": "partial"}
    links = spark.createDataFrame([("r", k, i) for i, k in enumerate(["mirror", "slow", "direct", "ad", "direct", "slow", "mirror"])], "r string, kind string, n int")
    assert [r.n for r in downloads.link_attempts(links, "r", "kind", "n").orderBy("attempt").collect()] == [2, 4, 1, 5, 0]

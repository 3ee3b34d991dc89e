"""The command line: verbs, what they print, exit codes."""

import json

import pytest
from pyspark.sql import functions as F

import shelfmark
from shelfmark import cli


def fetch(task):
    """Stands for a download: what it returns follows the source."""
    if task["source_id"] == "s2":
        raise RuntimeError("broken")
    return "deferred" if task["source_id"] == "s3" else "success"


@pytest.fixture
def inputs(spark, tmp_path):
    (tmp_path / "works.csv").write_bytes(b'entry_id,short_title,main_author,direct_link,retrievable\r\n001,The Old Mill,Ann,,\r\n002,River Song,,,\r\n003,"Night, Again",,,False\r\n004,Nothing Like It,,,\r\n005,Done Work,,,True\r\n006,,,https://x.org/iiif/6/manifest,\r\n')
    hits = [("001", "pa", "The old mill", "s1", "https://pa/1"), ("001", "pb", "Mill, old", "s9", None), ("002", "pa", "River song", "s2", None), ("003", "pb", "Night again", "s3", "https://pb/3"), ("004", "pa", "Quite another thing", "s4", None)]
    rows = spark.createDataFrame([(e, p, t, s, u, int(p == "pb"), 0) for e, p, t, s, u in hits], "entry_id string, provider_key string, title string, source_id string, item_url string, provider_ix int, hit_ix int")
    for name, value in (("creators", F.array(F.lit("Ann"))), ("date", F.lit("1801")), ("iiif_manifest", F.lit(None).cast("string"))):
        rows = rows.withColumn(name, value)
    rows.write.parquet(f"{tmp_path}/hits")
    return tmp_path


def test_batch(spark, inputs, capsys):
    works, hits, out = f"{inputs}/works.csv", f"{inputs}/hits", f"{inputs}/after"
    assert cli.main(["batch", works, hits]) == cli.USAGE
    assert cli.main(["batch", works, hits, "--dry-run"]) == cli.OK
    said = {x.split("\t")[0]: x.split("\t")[1] for x in capsys.readouterr().out.splitlines() if "\t" in x}
    assert said == {"001": "dry_run", "002": "dry_run", "003": "dry_run", "004": "no_match", "006": "dry_run"}
    assert cli.main(["batch", works, hits, "--fetch", "tests.test_cli:fetch", "--out", out, "--json"]) == cli.SOME
    assert json.loads(capsys.readouterr().out) == {"command": "batch", "processed": 5, "succeeded": 2, "failed": 2, "deferred": 1, "skipped": 0, "dry_run": False}
    after = {r.entry_id: (r.retrievable, r.link, r.download_provider) for r in shelfmark.read_works(spark, out).collect()}
    assert after["001"] == ("True", "https://pa/1", "pa") and after["002"][0] == "False" and after["003"][0] == "deferred" and after["004"][0] == "False" and after["005"][0] == "True" and after["006"][2] == "direct_iiif"
    assert [p for p in inputs.iterdir() if "backup_" in p.name]
    assert cli.main(["batch", works, hits, "--dry-run", "--mode", "failed", "--json"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["processed"] == 1
    assert cli.main(["batch", works, hits, "--dry-run", "--entry-ids", "001,002,005", "--limit", "1", "--json"]) == cli.OK
    assert json.loads(capsys.readouterr().out)["processed"] == 1


def test_search(inputs, capsys):
    assert cli.main(["search", f"{inputs}/works.csv", f"{inputs}/hits", "--entry-ids", "001"]) == cli.OK
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "001\tmatch\tpa\ts1" and len(lines) == 3
    assert cli.main(["search", f"{inputs}/works.csv", f"{inputs}/hits", "--json"]) == cli.SOME
    assert {json.loads(x)["entry_id"] for x in capsys.readouterr().out.splitlines()} == {"001", "002", "003", "004", "005"}
    assert cli.main(["search", f"{inputs}/missing.csv", f"{inputs}/hits"]) == cli.USAGE


def test_verify(spark, tmp_path, capsys):
    for name, data in (("a/objects/x.pdf", b"%PDF-1.7"), ("b/objects/x.pdf", b"<html>"), ("c/work.json", b'{"status":"deferred"}'), ("d/work.json", b'{"status":"completed","pages_expected":3,"n":{"m":[1]}}'), ("d/objects/1.jpg", b"x"), ("e/other/x", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert cli.main(["verify", str(tmp_path), "--json"]) == cli.SOME
    assert json.loads(capsys.readouterr().out) == {"command": "verify", "total": 3, "ok": 1, "partial": 2}
    assert cli.main(["verify", str(tmp_path)]) == cli.SOME
    assert "PDF contains HTML" in capsys.readouterr().out
    _, changes = shelfmark.verify(spark, str(tmp_path))
    new = {r.path.rpartition("/")[2]: r.document for r in changes.collect()}
    assert set(new) == {"b", "d"} and new["b"] is None
    d = json.loads(new["d"])
    assert d["status"] == "partial" and d["n"] == {"m": [1]} and d["pages_expected"] == 3


def test_direct_iiif(spark, tmp_path, capsys):
    body = '{"label":"A book","sequences":[{"canvases":[{"images":[{"resource":{"@id":"https://i/1.jpg"}}]}]}]}'
    spark.createDataFrame([("https://polona.pl/view/abc123/manifest", body), ("https://x.org/b/manifest", "no json")], "url string, body string").write.parquet(f"{tmp_path}/m")
    assert cli.main(["iiif", f"{tmp_path}/m", "--url", "https://polona.pl/view/abc123/manifest", "--name", "book"]) == cli.OK
    row = json.loads(capsys.readouterr().out)
    assert row["entry_id"] == "IIIF_book" and row["provider_key"] == "polona" and row["item_id"] == "abc123" and row["page_count"] == 1 and row["label"] == "A book"
    assert cli.main(["iiif", f"{tmp_path}/m"]) == cli.SOME
    assert cli.main(["iiif", f"{tmp_path}/m", "--name", "a", "--name", "b", "--name", "c"]) == cli.USAGE
    assert cli.direct_names(["u", "v"], ["s"]) == [("IIIF_0001", "s", "s_0001"), ("IIIF_0002", "s", "s_0002")]
    assert cli.direct_names(["u", "v"], []) == [("IIIF_0001", None, None), ("IIIF_0002", None, None)]


def test_quota(tmp_path, capsys):
    state = tmp_path / "state.json"
    items = [{"id": str(i), "title": f"T{i}", "provider_name": "P", "status": s, "retry_count": 1} for i, s in enumerate(["pending"] * 12 + ["completed"] * 3 + ["failed"])]
    state.write_text(json.dumps({"quotas": {"gb": {"daily_limit": 5, "downloads_used": 9}}, "deferred_items": items}))
    assert cli.main(["quota", str(state)]) == cli.OK
    out = capsys.readouterr().out
    assert "gb\t0/5\t5 left" in out and "... and 2 more" in out and "pending\t12\tretries 12" in out
    assert cli.main(["quota", str(state), "--cleanup"]) == cli.OK
    assert "removed: 3" in capsys.readouterr().out
    assert len(json.loads(state.read_text())["deferred_items"]) == 13
    state.write_text("{broken")
    assert cli.main(["quota", str(state)]) == cli.OK
    assert (tmp_path / "state.corrupt").read_text() == "{broken"


def test_other_verbs(inputs, capsys):
    assert cli.main(["providers"]) == cli.OK
    assert capsys.readouterr().out.splitlines()[0] == "annas_archive"
    assert cli.main(["identify", "bsb11280551\n", "nothing at all"]) == cli.SOME
    assert "bsb11280551\tmdz\thttps://api.digitale-sammlungen.de/iiif/presentation/v2/bsb11280551/manifest" in capsys.readouterr().out
    assert cli.main(["status", f"{inputs}/works.csv"]) == cli.OK
    assert "completed: 1" in capsys.readouterr().out
    assert cli.main(["pending", f"{inputs}/works.csv", "--limit", "-1"]) == cli.USAGE
    assert cli.main([]) == cli.USAGE


def test_names_of_the_package():
    for name in shelfmark.__all__:
        assert callable(getattr(shelfmark, name)), name

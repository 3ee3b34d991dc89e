"""The optional live source against a server of our own, and URL dialect helpers."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from shelfmark import config
from shelfmark.functions import dialects, ids, payload
from shelfmark.sources import records, works
from shelfmark.sources.http import HttpSource


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        good = self.path == "/ok"
        self.send_response(200 if good else 429)
        self.send_header("Content-Type", "application/json")
        self.send_header("Retry-After", "7")
        self.end_headers()
        self.wfile.write(b'{"a":1}' if good else b"")

    def log_message(self, *_):
        pass


def test_http_rows(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpSource)
    rows = spark.read.format("shelfmark_http").option("urls", f"{root}/ok {root}/slow http://127.0.0.1:9/").option("timeout", "5").load().collect()
    server.shutdown()
    by = {r.url.rpartition("/")[2]: r for r in rows}
    assert bytes(by["ok"].body) == b'{"a":1}' and by["slow"].status == 429 and by["slow"].retry_after == "7" and by[""].status is None and by[""].error


class Flaky(Handler):
    """Busy until a path was asked for three times."""

    seen: dict = {}

    def do_GET(self):
        n = Flaky.seen[self.path] = Flaky.seen.get(self.path, 0) + 1
        self.send_response(404 if self.path == "/gone" else 200 if n > 2 else 503)
        self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(b"done" if n > 2 else b"")


def test_http_attempts(spark):
    server = HTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpSource)

    def load(urls, attempts):
        rows = spark.read.format("shelfmark_http").option("urls", urls).option("attempts", str(attempts)).option("backoff", "0.01").option("timeout", "5").load().collect()
        return {r.url.rpartition("/")[2]: r for r in rows}

    got = load(f"{root}/a {root}/gone http://127.0.0.1:9/", 5)
    assert (got["a"].status, bytes(got["a"].body), got["a"].attempts) == (200, b"done", 3)
    assert (got["gone"].status, got["gone"].attempts) == (404, 1) and (got[""].status, got[""].attempts) == (None, 2)
    got = load(f"{root}/b", 2)
    assert (got["b"].status, got["b"].attempts) == (503, 2)
    server.shutdown()


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_dialects(spark):
    v = F.col("v")
    assert one(spark, "L'Été", dialects.search_text(F.lit("bne"), v, F.lit(None))).endswith(r"'l\'ete'))")
    assert one(spark, "a", F.size(dialects.relaxed(v, F.lit("b")))) == 5 and one(spark, "a", F.size(dialects.relaxed(v, F.lit(None).cast("string")))) == 3
    assert one(spark, "https://iiif.europeana.eu/x?f=3", dialects.with_key(v, "K")) == "https://iiif.europeana.eu/x?f=3&wskey=K"
    assert one(spark, "https://other.org/x", dialects.with_key(v, "K")) == "https://other.org/x"


def test_keys_and_headers(spark):
    assert config.with_keys(["ddb", "mdz", "dpla"], {"dpla": "MINE"}, {"MINE": "k"}) == (["mdz", "dpla"], ["ddb"])
    assert one(spark, "Authorization", ids.header_carries_credential(F.col("v"), F.lit("x"))) and not one(spark, "Accept", ids.header_carries_credential(F.col("v"), F.lit("x")))


def test_payload_edges(spark):
    assert one(spark, "<html><body>", payload.magic_problem(F.col("v").cast("binary"), F.lit(".pdf"))) == "PDF contains HTML"
    assert one(spark, "%PDF-1.4", payload.magic_problem(F.col("v").cast("binary"), F.lit(".pdf"))) is None
    assert one(spark, "x", payload.target_folder(F.lit(".exe"), [])) == "objects" and one(spark, "x", payload.target_folder(F.lit(".exe"), [".pdf"], False)) is None
    assert one(spark, "1.5", payload.megabytes(F.col("v"))) == 1_572_864 and one(spark, "-1", payload.gigabytes(F.col("v"))) is None
    assert payload.MEDIA_TYPES[".tif"] == one(spark, ".TIF", payload.media_type(F.col("v")))


def test_long_bodies_are_errors(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpSource)

    def load(most):
        return spark.read.format("shelfmark_http").option("urls", f"{root}/ok").option("maxBytes", str(most)).load().first()

    fits, cut = load(7), load(6)
    server.shutdown()
    assert bytes(fits.body) == b'{"a":1}' and fits.error is None
    assert cut.body is None and "longer than 6" in cut.error and cut.status == 200


def test_line_ends_and_collections(spark, tmp_path):
    (tmp_path / "wide.csv").write_bytes(b"abcdefgh," * 15_000 + b"b\r\n1,2\r\n")
    (tmp_path / "plain.csv").write_text('id,t\n1,"two\nlines"\n2,x\n')
    (tmp_path / "none.csv").write_text("id,t\n")
    assert works.line_end(spark, str(tmp_path / "wide.csv")) == "\r\n" and works.line_end(spark, str(tmp_path / "plain.csv")) == "\n"
    found = {r.path.rpartition("/")[2]: r.rows for r in works.collections(spark, str(tmp_path)).collect()}
    assert found == {"wide.csv": 1, "plain.csv": 2, "none.csv": 0}


def test_blanks_of_any_kind_go(spark):
    for text, want in (("bsb11280551\n", ["mdz"]), ("\tbsb11280551 ", ["mdz"]), ("bsb11280551\r\n", ["mdz"]), ("bsb1\n2", [])):
        assert one(spark, text, ids.providers_of_identifier(F.col("v"))) == want
    assert one(spark, "\thttps://x.org/manifest ", ids.is_manifest_url(F.col("v")))


def test_tags_alone_lose_their_prefixes(spark):
    body = '<r xmlns:a="u"><a:recordData><dc><dc:title>Table of rates pct:x = 5 and more, 3 &gt; 2 a:b = 1</dc:title><dc:identifier q:r = "1">ark:/81055/v1</dc:identifier></dc></a:recordData></r>'.replace("<dc>", '<dc xmlns:dc="d" xmlns:q="q">')
    df = spark.createDataFrame([(1, "british_library", body)], "k int, p string, b string")
    got = records.sru_records(df, "british_library", "k", "b").collect()
    assert [r.title for r in got] == ["Table of rates pct:x = 5 and more, 3 > 2 a:b = 1"]

"""Queries over files: tables are written in the shared folder in the shapes of the sources and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as cf
from ..operators import audit as au
from ..operators import iiif
from ..operators import transfers as tr
from ..operators import verify as vf
from ..session import scratch
from ..sources import state as ss
from ..sources import works as wk
from .ledgers import QUEUE, QUOTAS, now, queue, quotas
from .manifests import manifests
from .registry import query
from .views import norm_sql, table


def written_works(spark, sf_dir, line_sep: str = "\r\n") -> str:
    """A works CSV of the orders, with quotes, commas and line breaks in its cells; returns its folder."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(k.cast("string"), 9, "0").alias("entry_id"), F.concat(F.lit('The "'), "o_orderpriority", F.lit('", part '), k, F.lit("\nof more")).alias("short_title"),
        F.when(k % 3 == 0, "NULL").when(k % 3 == 1, "").otherwise("N/A").alias("main_author"), F.when(k % 2 == 0, "True").alias("retrievable"), F.concat(F.lit(" x "), k).alias("Own Column"),
    )
    path = f"{scratch(spark, 'works')}/works"
    wk.write_csv(rows, path, line_sep)
    return path


CELLS = "lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS entry_id, 'The \"' || o_orderpriority || '\", part ' || o_orderkey || chr(10) || 'of more' AS short_title, CASE o_orderkey % 3 WHEN 0 THEN 'NULL' WHEN 1 THEN '' ELSE 'N/A' END AS main_author"


@query(f"SELECT {CELLS}, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE '' END AS retrievable, NULL::VARCHAR AS direct_link, ' x ' || o_orderkey AS own FROM orders")
def works_scan(spark, sf_dir):
    """A works CSV, written and read back: every cell as text, missing columns added, unknown ones kept."""
    return wk.read_works(spark, written_works(spark, sf_dir)).select("entry_id", "short_title", "main_author", "retrievable", "direct_link", F.col("Own Column").alias("own"))


@query(f"SELECT {CELLS} FROM orders")
def text_scan(spark, sf_dir):
    return wk.read_csv_text(spark, written_works(spark, sf_dir, "\n")).select("entry_id", "short_title", "main_author")


@query("SELECT 'crlf' AS file, 2 AS length UNION ALL SELECT 'lf', 1")
def line_ends(spark, sf_dir):
    """The line end that a CSV was written with."""
    one = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("entry_id"))
    folder = scratch(spark, "ends")
    out = []
    for name, sep in (("crlf", "\r\n"), ("lf", "\n")):
        wk.write_csv(one, f"{folder}/{name}", sep, one_file=True)
        out.append((name, len(wk.line_end(spark, f"{folder}/{name}"))))
    return spark.createDataFrame(out, "file string, length int")


@query("SELECT 'orders' AS collection, count(*) AS rows FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def collection_rows(spark, sf_dir):
    """CSV files with their rows; line breaks in cells end none."""
    folder = scratch(spark, "collections")
    k = F.col("o_orderkey")
    wk.write_csv(table(spark, sf_dir, "orders").select(k.cast("string").alias("entry_id"), F.concat(F.lit("a\nb "), k).alias("short_title")), f"{folder}/orders", one_file=True)
    wk.write_csv(table(spark, sf_dir, "region").select(F.col("r_name").alias("entry_id")), f"{folder}/region", one_file=True)
    return wk.collections(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("collection"), "rows")


@query("SELECT 'E0001' AS entry_id, 'A title' AS short_title, NULL::VARCHAR AS main_author, 'pending' AS status")
def adhoc_query(spark, sf_dir):
    from ..operators.ledger import parse_status

    return wk.query_frame(spark, "A title").select("entry_id", "short_title", "main_author", parse_status(F.col("retrievable")).alias("status"))


@query("SELECT 'backup' AS copy, count(*) AS rows, count(DISTINCT entry_id) AS entries FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS entry_id FROM orders)")
def works_backup(spark, sf_dir):
    """The copy that is taken of a works table before its first change."""
    path = written_works(spark, sf_dir)
    copy = wk.backup(spark, path, "20240115_120000")
    return wk.read_csv_text(spark, copy).select(F.lit("backup").alias("copy"), "entry_id").groupBy("copy").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entry_id").alias("entries"))


INDEXED = f"""indexed AS (SELECT o_orderkey AS k, substr(sha1({norm_sql("'T ' || o_orderpriority || o_orderkey")} || '|' || {norm_sql("'A ' || o_custkey")}), 1, 10) AS work_id FROM orders)"""


@query(
    "SELECT k, work_id, CASE WHEN k % 4 < 3 THEN 'p' || k ELSE '' END AS selected_provider_key, CASE WHEN k % 4 < 3 THEN 'https://x/' || k ELSE '' END AS item_url, 'completed' AS status, '2024-01-15T12:00:00Z' AS created_at, '' AS late FROM indexed",
    INDEXED,
)
def index_scan(spark, sf_dir):
    """Index rows built, written as CSV and read back; a later column that the file lacks is there and empty."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    works = o.select(k.alias("k"), k.cast("string").alias("entry_id"), F.concat(F.lit("T "), "o_orderpriority", k).alias("short_title"), F.concat(F.lit("A "), "o_custkey").alias("main_author"))
    chosen = o.filter(k % 4 < 3).select(k.alias("k"), F.concat(F.lit("p"), k).alias("provider_key"), F.lit("P").alias("provider"), F.lit("s").alias("source_id"), F.concat(F.lit("https://x/"), k).alias("item_url"))
    path = f"{scratch(spark, 'index')}/index"
    wk.write_csv(au.index_rows(works, chosen, "k", now()).drop("updated_at"), path)
    back = wk.read_index(spark, path)
    return back.select(F.col("entry_id").cast("long").alias("k"), "work_id", "selected_provider_key", "item_url", "status", "created_at", F.col("updated_at").alias("late"))


ITEMS = "items AS (SELECT CAST(substr(id, 2) AS BIGINT) AS n, * FROM queue)"


def saved(spark, sf_dir, name: str) -> str:
    path = f"{scratch(spark, 'state')}/{name}"
    q = queue(spark, sf_dir).withColumn("ord", F.substring("id", 2, 20).cast("long"))
    none = F.lit(None).cast("string")
    given = {c: F.col(c) if c in q.columns else none for c in ss.ITEM_FIELDS}
    items = q.select("ord", *[v.alias(c) for c, v in given.items()], F.concat(F.lit('{"n":['), "ord", F.lit("]}")).alias("raw_data"))
    quota = quotas(spark, sf_dir).select("provider_key", "daily_limit", F.col("reset_hours").cast("int").alias("reset_hours"), "downloads_used", "period_start", none.alias("exhausted_at"))
    ss.write_state(spark, path, quota, items, "ord", now())
    return path


@query("SELECT id, title, creator, entry_id, provider_key, source_id, reset_time, retry_count, status, '{\"n\":[' || n || ']}' AS raw_data FROM items", QUEUE, ITEMS)
def state_items(spark, sf_dir):
    """The deferred queue through the state file."""
    how, _, items = ss.load_state(spark, saved(spark, sf_dir, "state.json"))
    assert how == "loaded", how
    return items.select("id", "title", "creator", "entry_id", "provider_key", "source_id", "reset_time", "retry_count", "status", "raw_data")


@query("SELECT provider_key, daily_limit, CAST(reset_hours AS INTEGER) AS reset_hours, downloads_used, period_start FROM quotas", QUOTAS)
def state_quotas(spark, sf_dir):
    _, quota, _ = ss.load_state(spark, saved(spark, sf_dir, "state.json"))
    return quota.select("provider_key", "daily_limit", "reset_hours", "downloads_used", "period_start")


ODD = '{"quotas":{"a":{"daily_limit":"7"},"b":{"daily_limit":"many"},"c":5,"d":{}},"deferred_items":[{"id":"1","retry_count":2,"raw_data":{"x":[1]}},7,{"id":"2","retry_count":"x"},{"id":"3","status":null}]}'


@query("SELECT * FROM (VALUES ('odd', 'loaded', 'a:7 d:10', '1:2:pending:{\"x\":[1]} 3:0:~:{}', FALSE), ('corrupt', 'corrupt', '', '', TRUE), ('list', 'corrupt', '', '', TRUE), ('absent', 'fresh', '', '', FALSE), ('old', 'migrated', 'z:3', '9:0:pending:{}', FALSE)) t(file, how, quotas, items, copied)")
def state_cases(spark, sf_dir):
    """State files with malformed records, without an object, absent, and in their old two parts."""
    folder = scratch(spark, "states")
    old = (f"{folder}/old_quota.json", f"{folder}/old_queue.json")
    for path, text in ((f"{folder}/odd.json", ODD), (f"{folder}/corrupt.json", "{broken"), (f"{folder}/list.json", "[1]"), (old[0], '{"quotas":{"z":{"daily_limit":3}}}'), (old[1], '{"version":"1","items":[{"id":"9"}]}')):
        ss.save_state(spark, path, text)
    out = []
    for name in ("odd", "corrupt", "list", "absent", "old"):
        how, quota, items = ss.load_state(spark, f"{folder}/{name}.json", old if name == "old" else None)
        copied = ss._fs(spark, folder)[0].exists(ss._fs(spark, f"{folder}/{name}.corrupt")[1])
        q = " ".join(f"{r.provider_key}:{r.daily_limit}" for r in quota.orderBy("provider_key").collect())
        i = " ".join(f"{r.id}:{r.retry_count}:{r.status or '~'}:{r.raw_data}" for r in items.orderBy("ord").collect())
        out.append((name, how, q, i, copied))
    return spark.createDataFrame(out, "file string, how string, quotas string, items string, copied boolean")


@query("SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS entry_id, CASE WHEN o_orderkey % 3 = 0 THEN 'no_candidates' WHEN o_orderkey % 3 = 1 THEN 'no_match' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 2 END AS n, CASE WHEN o_orderkey % 3 > 0 THEN 't1' END AS first_title, CASE WHEN o_orderkey % 3 = 2 THEN 's0' END AS selected FROM orders")
def work_documents(spark, sf_dir):
    """Work documents with their candidates, written as files of text and read back."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    works = o.select(k.alias("k"), k.cast("string").alias("entry_id"), F.lit('T "q"').alias("short_title"), F.lit("a").alias("main_author"))
    each = [F.struct(F.lit(1 - i).alias("hit_ix"), F.lit(f"t{i}").alias("title"), F.lit(f"s{i}").alias("source_id")) for i in range(2)]
    c = o.filter(k % 3 > 0).select(k.alias("k"), F.explode(F.array(*each)).alias("c")).select("k", "c.*")
    c = c.select("*", F.lit(0).alias("provider_ix"), F.lit("P").alias("provider"), F.lit("p").alias("provider_key"), F.array(F.lit("x")).alias("creators"), F.lit("1800").alias("date"), F.lit("u").alias("item_url"), F.lit("m").alias("iiif_manifest"), F.lit(90).alias("title_score"), F.lit(0).alias("creator_score"), F.lit(0.0).alias("year_penalty"), F.lit(93.5).alias("total"))
    docs = au.work_documents(works, c, c.filter("hit_ix = 1 and k % 3 = 2"), "k", now())
    path = f"{scratch(spark, 'documents')}/documents"
    au.write_documents(docs, path)
    # one document a line
    back = spark.read.text(path).select(F.col("value").alias("d"))
    at = lambda p: F.get_json_object("d", p)
    return back.select(at("$.input.entry_id").cast("long").alias("k"), at("$.input.entry_id").alias("entry_id"), at("$.status").alias("status"), F.nullif(F.size(F.try_variant_get(F.parse_json("d"), "$.candidates", "array<variant>")), F.lit(-1)).alias("n"), at("$.candidates[0].title").alias("first_title"), at("$.selected.source_id").alias("selected"))


STORED = """stored AS (SELECT page_id, 'w' || (page_id % 20) AS work, CASE page_id % 4 WHEN 0 THEN 'p' || page_id || '.pdf' WHEN 1 THEN 'p' || page_id || '.jpg' WHEN 2 THEN 'p' || page_id || '.html' END AS name, CASE page_id % 4 WHEN 0 THEN 'objects' WHEN 1 THEN 'objects' WHEN 2 THEN 'metadata' END AS folder,
  CASE page_id % 4 WHEN 0 THEN 9 + length(CAST(page_id AS VARCHAR)) WHEN 1 THEN 4 WHEN 2 THEN 12 END AS bytes FROM pages)"""


def sunk(spark, sf_dir) -> tuple[str, object]:
    """(folder, stored files): PDF, JPEG, HTML and refused payloads of pages in their work folders."""
    i = F.col("page_id")
    body = F.when(i % 4 == 0, F.concat(F.lit("%PDF-1.7\n").cast("binary"), i.cast("string").cast("binary"))).when(i % 4 == 1, F.unhex(F.lit("FFD8FFE0"))).when(i % 4 == 2, F.lit("<html></html>"[:12]).cast("binary")).otherwise(F.lit("<!DOCTYPE html>").cast("binary"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("w"), i % 20).alias("work"), body.alias("body"), F.when(i % 4 == 0, "https://x/a.pdf").when(i % 4 == 3, "https://x/b.pdf?c").otherwise("https://x/c").alias("url"), F.when(i % 4 == 2, "text/html").when(i % 4 == 1, "image/jpeg").otherwise("application/pdf").alias("content_type"))
    made = tr.decided(p, [".pdf", ".jpg"]).withColumn("name", F.concat(F.lit("p"), i, F.col("extension")))
    root = scratch(spark, "sink")
    out = tr.store_payloads(made, root, "work", "name")
    path = f"{scratch(spark, 'sunk')}/rows"
    out.write.parquet(path)
    return root, spark.read.parquet(path)


@query("SELECT work, work || '/' || folder || '/' || name AS path, bytes FROM stored WHERE name IS NOT NULL", STORED)
def download_sink(spark, sf_dir):
    """Payloads stored by their kind; HTML in place of a document is not stored."""
    return sunk(spark, sf_dir)[1]


@query("SELECT work, name, bytes AS length FROM stored WHERE folder = 'objects'", STORED)
def stored_files(spark, sf_dir):
    """The objects of work folders, listed where they lie."""
    root, rows = sunk(spark, sf_dir)
    rows.count()
    files = vf.stored_files(vf.work_folders(spark, root))
    return files.select(F.element_at(F.split("work_dir", "/"), -1).alias("work"), "name", "length")


@query("SELECT 'w' || (page_id % 20) AS path, TRUE AS ok FROM pages WHERE page_id % 4 < 2 GROUP BY 1", STORED)
def verify_run(spark, sf_dir):
    """A check of all work folders by what lies in them."""
    root, rows = sunk(spark, sf_dir)
    rows.count()
    checked, changes = vf.verify(spark, root)
    assert changes.isEmpty()
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("path"), "ok")


@query("SELECT work, ord, CASE WHEN seq > 1 THEN 's_ia_' || seq ELSE 's_ia' END || '.json' AS filename, bytes FROM (SELECT work, ord, bytes, row_number() OVER (PARTITION BY work ORDER BY ord) AS seq FROM (SELECT conv_id AS work, turn AS ord, octet_length(encode(text)) AS bytes, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, max(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS most FROM conversations) WHERE TRUE)")
def metadata_names(spark, sf_dir):
    """Numbered names of metadata documents within a budget that holds them all."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("ord"), F.col("text").alias("body"), F.lit("s").alias("stem"), F.lit("ia").alias("slug"))
    return tr.metadata_plan(c, "work", "stem", "slug", "body", "ord", 10**9).select("work", "ord", "filename", "bytes")


@query("SELECT c_custkey AS k, 1 AS ord, 's_ia.json' AS filename FROM customer UNION ALL SELECT c_custkey, 3, 's_ia_2.json' FROM customer")
def metadata_budget(spark, sf_dir):
    """A document beyond the budget is not written and takes no number."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.repeat(F.lit("x"), n).alias("body")) for i, n in ((1, 40), (2, 70), (3, 60))])).alias("d")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), each).select("k", "d.*", F.lit("s").alias("stem"), F.lit("ia").alias("slug"))
    return tr.metadata_plan(rows, "k", "stem", "slug", "body", "ord", 100).select("k", "ord", "filename")


SHOWN = """shown AS (SELECT conv_id AS c, count(*) AS n FROM conversations WHERE conv_id % 10 <> 9 GROUP BY 1)"""


@query("SELECT c, 'polona' AS provider_key, 'C' || c AS label, CASE WHEN c % 2 = 0 THEN 2 ELSE 1 END AS n_formats FROM shown", SHOWN)
def manifest_preview(spark, sf_dir):
    """What manifests would bring: their label and the renderings that a download would try."""
    m = manifests(spark, sf_dir).select(F.concat(F.lit("https://polona.pl/view/c"), "c", F.lit("/manifest")).alias("url"), "body")
    out = tr.preview(m, "url", "body").filter("label is not null")
    return out.select(F.substring("item_id", 2, 20).cast("long").alias("c"), "provider_key", "label", F.size("rendering_formats").alias("n_formats"))


@query("SELECT o_orderkey AS k, 'https://i/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '/full/' || (1000 + o_orderkey % 100) || ',/0/default.jpg' ELSE '/full/full/0/default.jpg' END AS first_url, 3 AS tries FROM orders")
def image_infos(spark, sf_dir):
    """Services with their captured info.json: what is tried first, three URLs at most before it is known."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    services = o.select(k.alias("k"), F.concat(F.lit("https://i/"), k, F.lit("/")).alias("base"))
    infos = o.filter(k % 2 == 0).select(F.concat(F.lit("https://i/"), k).alias("base"), F.concat(F.lit('{"sizes":[{"width":10},{"width":'), 1000 + k % 100, F.lit("}]}")).alias("body"))
    out = iiif.with_image_info(services, "base", infos, "base", "body")
    return out.select("k", F.get("urls", F.lit(0)).alias("first_url"), F.size("tries").alias("tries"))


SETTINGS = {"provider_settings": {"gallica": {"max_pages": "12", "search_timeout_seconds": 9, "delay_ms": 5}, "loc": {"max_images": 7.9, "min_title_score": "61"}, "ddb": {"max_pages": "all", "search_timeout_seconds": 0}}, "selection": {"min_title_score": "x", "search_timeout_seconds": 4}, "download": {"include_metadata": False, "max_parallel_downloads": "3"}}


@query("""SELECT * FROM (VALUES
  ('pages bnf_gallica', '12'), ('pages loc', '7'), ('pages ddb', NULL), ('pages mdz', NULL), ('score loc', '61.0'), ('score mdz', '85.0'), ('timeout bnf_gallica', '9.0'), ('timeout ddb', NULL), ('timeout mdz', '4.0'),
  ('delay bnf_gallica', '5'), ('attempts mdz', '5'), ('metadata', 'False'), ('renderings', '1'), ('parallel', '3'), ('parallel 8', '8'), ('parallel none', '1'), ('resume', 'skip_completed'),
  ('keys', 'mdz loc | ddb dpla'), ('only', 'loc mdz | nope'), ('enable', 'mdz ddb loc'), ('disable', 'ddb'), ('order', 'loc mdz ddb'), ('strategy', 'collect_and_select')) t(name, value)""")
def settings_cases(spark, sf_dir):
    """Settings by their precedence: provider, selection, default; keys; overrides."""
    c = SETTINGS
    usable, missing = cf.with_keys(["mdz", "ddb", "loc", "dpla"], None, {})
    only, unknown = cf.override_providers(["mdz", "ddb"], ["mdz", "ddb", "loc"], "loc,mdz,nope")
    rows = [
        *[(f"pages {p}", cf.max_pages(c, p)) for p in ("bnf_gallica", "loc", "ddb", "mdz")], *[(f"score {p}", cf.min_title_score(c, p, 85.0)) for p in ("loc", "mdz")], *[(f"timeout {p}", cf.search_timeout(c, p, None)) for p in ("bnf_gallica", "ddb", "mdz")],
        ("delay bnf_gallica", cf.network_policy(c, "bnf_gallica")["delay_ms"]), ("attempts mdz", cf.network_policy(c, "mdz")["max_attempts"]), ("metadata", cf.download_settings(c)["include_metadata"]), ("renderings", cf.download_settings(c)["max_renderings_per_manifest"]),
        ("parallel", cf.parallel_downloads(c)), ("parallel 8", cf.parallel_downloads(c, 8)), ("parallel none", cf.parallel_downloads({"download": {"max_parallel_downloads": "x"}})), ("resume", cf.resume_mode(c)),
        ("keys", f"{' '.join(usable)} | {' '.join(missing)}"), ("only", f"{' '.join(only)} | {' '.join(unknown)}"), ("enable", " ".join(cf.override_providers(["mdz", "ddb"], ["mdz", "ddb", "loc"], None, "loc")[0])),
        ("disable", " ".join(cf.override_providers(["mdz", "ddb"], ["mdz", "ddb"], None, None, "mdz")[0])), ("order", " ".join(cf.provider_order(["mdz", "ddb", "loc"], ["loc", "x", "mdz"]))), ("strategy", cf.Selection.of(c).strategy),
    ]
    return spark.createDataFrame([(n, None if v is None else str(v)) for n, v in rows], "name string, value string")

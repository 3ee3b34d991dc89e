"""Queries over downloads: gates, attempts, accounting, outcomes, plans, and small rules of providers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import dates, payload, text
from ..operators import downloads as dl
from ..operators import ledger as lg
from ..operators import queue as dq
from ..operators import select as sel
from ..operators import transfers as tr
from ..sources import records as rec
from .ledgers import QUEUE, QUOTAS, now, queue, quotas
from .matching import ALL, GATE, lower_bound_scores
from .registry import query
from .urls import kind_sql, of_kind
from .views import LEDGER, OUTCOMES, STATUS_SQL, ledger, outcomes, table

ERRORS = ["Connection refused", "HTTPSConnectionPool: NewConnectionError", "read timeout", "No route to host!", ""]


@query(
    f"""SELECT user_id, CAST(min(CASE WHEN ends THEN n END) AS INTEGER) AS attempts, CASE WHEN arg_min(outcome, n) FILTER (WHERE ends) = 'retry' THEN 'failure' ELSE arg_min(outcome, n) FILTER (WHERE ends) END AS outcome FROM (
      SELECT *, outcome <> 'retry' OR n >= CASE WHEN error IN ('Connection refused', 'HTTPSConnectionPool: NewConnectionError', 'No route to host!') THEN 2 ELSE 5 END AS ends FROM (
        SELECT user_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'failure' ELSE 'retry' END AS outcome, {kind_sql(ERRORS, 'event_id')} AS error,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5) GROUP BY 1"""
)
def attempt_loops(spark, sf_dir):
    """Retry loops over recorded attempts; a connection that was never made is tried twice at most."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "failure").otherwise("retry")
    rows = e.select("user_id", "event_id", outcome.alias("outcome"), of_kind(ERRORS, F.col("event_id")).alias("error"))
    return tr.attempts_made(rows, "user_id", "event_id", "outcome", "error", 5)


@query(
    """SELECT event_id, CASE WHEN p % 4 = 0 AND q.exhausted THEN CASE WHEN p % 3 = 0 THEN 'fallback' ELSE 'defer' END ELSE 'go' END AS gate, CASE WHEN p % 4 = 0 AND q.exhausted AND p % 3 > 0 THEN strftime(q.reset_at, '%Y-%m-%d %H:%M:%S') END AS reset_at
    FROM (SELECT event_id, user_id AS p, 'p' || user_id AS provider_key FROM events) e LEFT JOIN quota q USING (provider_key)""",
    QUOTAS,
)
def quota_gates(spark, sf_dir):
    tasks = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("p"), "user_id").alias("provider_key"))
    n = F.substring("provider_key", 2, 9).cast("int")
    view = dq.quota_view(quotas(spark, sf_dir), now()).withColumn("wait_for_reset", F.when(n % 3 == 0, False).when(n % 3 == 1, True))
    limited = [f"p{i}" for i in range(0, 100_000, 4)][:2000]
    return tr.quota_gate(tasks, view, limited).select("event_id", "gate", F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at"))


@query("SELECT provider_key, count(*) FILTER (WHERE ok AND coalesce(fast, TRUE)) AS used FROM (SELECT 'p' || (user_id % 6) AS provider_key, event_type = 'purchase' AS ok, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS fast FROM events) WHERE provider_key IN ('p1', 'p2') GROUP BY 1")
def quota_uses(spark, sf_dir):
    """Only downloads over the counted way use a unit."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id") % 6).alias("provider_key"), (F.col("event_type") == "purchase").alias("ok"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("fast_path"))
    return tr.quota_uses(rows, ["p1", "p2"])


@query(
    """SELECT k, CASE WHEN r IS NOT NULL THEN 'completed' WHEN d THEN 'deferred' ELSE 'failed' END AS outcome, CAST(r AS INTEGER) AS rank FROM (
      SELECT l_orderkey AS k, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber - 1 END) AS r, bool_or(l_linenumber = 1 AND l_partkey % 3 = 0) AS d FROM lineitem GROUP BY 1)"""
)
def fallback_outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("rank"), (F.col("l_returnflag") == "R").alias("ok"), (F.col("l_partkey") % 3 == 0).alias("deferred"))
    return tr.fallback_outcomes(li, "k")


@query(
    """SELECT user_id AS k, CASE WHEN s IN ('completed', 'partial') AND c > seen THEN 'partial' ELSE coalesce(s, 'pending') END AS status FROM (
      SELECT user_id, arg_max(st, event_id) FILTER (WHERE st <> 'check_failed') AS s, max(event_id) FILTER (WHERE st <> 'check_failed') AS seen, max(event_id) FILTER (WHERE st = 'check_failed') AS c FROM (
        SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'check_failed' WHEN 'signup' THEN 'deferred' WHEN 'view' THEN 'no_match' ELSE 'unknown' END AS st FROM events) WHERE st <> 'unknown' GROUP BY 1)"""
)
def status_lifecycle(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "check_failed").when(kind == "signup", "deferred").when(kind == "view", "no_match").otherwise("unknown")
    return tr.lifecycle(table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", status.alias("status")), "k", ["event_id"])


@query(
    """WITH RECURSIVE chunks AS (SELECT c_custkey AS ix, c_mktsegment AS kind, c_custkey // 40 AS file, CAST(trunc(abs(c_acctbal)) AS BIGINT) + 1 AS size FROM customer),
    chain AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ix) AS n, coalesce(lead(file) OVER (PARTITION BY kind ORDER BY ix) <> file, TRUE) AND file % 5 = 0 AS gone FROM chunks),
    limits AS (SELECT * FROM (VALUES ('BUILDING', 150000), ('MACHINERY', 20000)) t(kind, most)),
    walk AS (
      SELECT kind, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ix, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS file, CAST(0 AS BIGINT) AS mine, FALSE AS dead FROM (SELECT DISTINCT kind FROM chain)
      UNION ALL
      SELECT kind, n, ix, ok, CASE WHEN gone OR NOT (ok OR dead) THEN booked - own ELSE booked END, file, CASE WHEN gone OR NOT (ok OR dead) THEN 0 ELSE own END, dead OR NOT ok FROM (
        SELECT *, CASE WHEN ok THEN used + size ELSE used END AS booked, CASE WHEN ok THEN mine + size ELSE mine END AS own FROM (
          SELECT c.kind, c.n, c.ix, c.file, c.size, c.gone, w.used, CASE WHEN c.file = w.file THEN w.mine ELSE 0 END AS mine, c.file = w.file AND w.dead AS dead,
            NOT (c.file = w.file AND w.dead) AND (l.most IS NULL OR w.used + c.size <= l.most) AS ok FROM walk w JOIN chain c ON c.kind = w.kind AND c.n = w.n + 1 LEFT JOIN limits l ON l.kind = c.kind)))
    SELECT ix, ok AS accepted, used FROM walk WHERE n > 0"""
)
def chunk_accounting(spark, sf_dir):
    """Bytes booked chunk by chunk; refused and discarded files give theirs back."""
    from pyspark.sql import Window

    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("ix"), F.col("c_mktsegment").alias("kind"), F.floor(k / 40).alias("file"), (F.abs("c_acctbal").cast("long") + 1).alias("size"))
    following = F.lead("file").over(Window.partitionBy("kind").orderBy("ix"))
    c = c.withColumn("gone", F.coalesce(following != F.col("file"), F.lit(True)) & (F.col("file") % 5 == 0))
    return tr.chunk_accounting(c, "kind", "ix", "file", "size", "gone", {"BUILDING": 150_000, "MACHINERY": 20_000}).select("ix", "accepted", "used")


MARKERS = ["log in", "become a member"]


@query("SELECT event_id, event_id % 3 < 2 AND event_id % 4 < 2 AS login FROM events")
def login_pages(spark, sf_dir):
    i = F.col("event_id")
    head = F.when(i % 4 == 0, "<html>Please LOG IN").when(i % 4 == 1, F.concat(F.repeat(F.lit("x"), 1990), F.lit("Become a Member"))).when(i % 4 == 2, F.concat(F.repeat(F.lit("x"), 2040), F.lit("become a member"))).otherwise("book")
    url = F.when(i % 3 == 0, "https://Annas-Archive.org/x").otherwise("https://x.org")
    return table(spark, sf_dir, "events").select("event_id", tr.login_page(head.cast("binary"), url, F.when(i % 3 == 1, "annas-archive"), MARKERS).alias("login"))


FILES = ["a b.pdf", "x_TEXT.pdf", "c.EPUB", "d.djvu", "e.txt", "noext"]


@query("SELECT c_custkey AS k, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY r, p) AS INTEGER) AS place, 'https://archive.org/download/' || c_custkey || '/' || n AS url FROM customer, (VALUES (0, 0, 'a%20b.pdf', 0), (1, 5, 'noext', 0), (2, 2, 'c.EPUB', 1), (3, 3, 'd.djvu', 2), (0, 1, 'x_TEXT.pdf', 0)) t(m, p, n, r) WHERE CASE WHEN n = 'x_TEXT.pdf' THEN c_custkey % 4 = 0 ELSE c_custkey % 4 <> m END")
def archive_files(spark, sf_dir):
    """Files of archive items in the order in which they are tried."""
    k = F.col("c_custkey")

    def file(name, fmt, source, left_out):
        made = F.to_json(F.struct(F.lit(name).alias("name"), F.lit(fmt).alias("format"), source.alias("source")))
        return F.when(k % 4 != left_out, made) if left_out is not None else made

    files = F.array(
        file("a b.pdf", "Text PDF", F.lit("original"), 0), file("x_TEXT.pdf", "PDF", F.when(k % 4 == 0, "original").otherwise("Derivative"), None), file("c.EPUB", "EPUB", F.lit("derivative"), 2),
        file("d.djvu", "DjVu", F.lit("derivative"), 3), file("e.txt", "DjVuTXT", F.lit("derivative"), None), file("noext", "Image Container PDF", F.lit("original"), 1),
    )
    body = F.concat(F.lit('{"files":['), F.array_join(F.filter(files, lambda f: f.isNotNull()), ","), F.lit("]}"))
    return tr.archive_files(table(spark, sf_dir, "customer").select(k.alias("k"), body.alias("body")), "k", "body")


IMAGES = [('{{"item":{{"image_url":["//t/a.jpg","//t/{0}.jpg"]}}}}', "https://t/{0}.jpg"), ('{{"item":{{"image_url":[{{"full":"http://f/{0}"}}]}}}}', "http://f/{0}"), ('{{"item":{{"image_url":"/l/{0}"}}}}', "https://www.loc.gov/l/{0}"), ('{{"item":{{"image_url":[]}}}}', None), ("broken {{", None)]


@query(f"SELECT c_custkey AS k, {kind_sql([u for _, u in IMAGES], 'c_custkey')} AS url FROM customer")
def loc_images(spark, sf_dir):
    k = F.col("c_custkey")
    body = of_kind([b.replace("{{", "{").replace("}}", "}") for b, _ in IMAGES], k)
    return tr.loc_image(table(spark, sf_dir, "customer").select(k.alias("k"), body.alias("body")), "k", "body")


UUID = "'0000abcd-0000-0000-0000-' || lpad(CAST({0} AS VARCHAR), 12, '0')"


@query(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN {UUID.format('o_orderkey')} WHEN o_orderkey % 3 = 1 AND c_custkey IS NOT NULL THEN {UUID.format('c_custkey')} END AS digital_id FROM orders LEFT JOIN customer ON c_custkey = o_orderkey AND c_custkey % 2 = 0")
def digital_copies(spark, sf_dir):
    """Catalogue ids led to the first digital copy that a captured link names."""
    k = F.col("o_orderkey")
    uuid = lambda n: F.concat(F.lit("0000ABCD-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))
    value = F.when(k % 3 == 0, F.concat(F.lit("https://bd.bne.es/card?id="), uuid(k))).when(k % 3 == 1, F.concat(F.lit("https://datos.bne.es/resource/bi"), k)).otherwise("none")
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    links = c.select(F.concat(F.lit("bi"), "c_custkey").alias("resource"), F.explode(F.array(F.struct(F.lit(2).alias("ord"), F.lit("late").alias("digital")), F.struct(F.lit(1).alias("ord"), F.concat(F.lit("https://bd/"), uuid(F.col("c_custkey"))).alias("digital")))).alias("l")).select("resource", "l.*")
    return tr.digital_copies(table(spark, sf_dir, "orders").select(k.alias("k"), value.alias("v")), "k", "v", links)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 < 2 THEN 'https://digital.x/id' || c_custkey || 'X/1' END AS url, CASE WHEN c_custkey % 3 < 2 THEN c_custkey || 'X' END AS ppn FROM customer")
def source_links(spark, sf_dir):
    """The first link of field 856, and the PPN in it."""
    k = F.col("c_custkey")
    link = F.concat(F.lit('{"u":"https://digital.x/id'), k, F.lit('X/1"}'))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"856":[{"41":[{"z":"x"},'), link, F.lit(',{"u":"https://late"}]}]}'))).when(k % 3 == 1, F.concat(F.lit('{"856":[{"41":[{"u":""}]},{"42":['), link, F.lit("]}]}"))).otherwise('{"856":null}')
    return tr.source_links(table(spark, sf_dir, "customer").select(k.alias("k"), body.alias("b")), "k", "b")


@query("SELECT * FROM (VALUES ('bnf_gallica', NULL, 'gallica', 'GAL'), ('', 'internet_archive', 'ia', NULL), (NULL, NULL, 'unknown', NULL), ('New Host2', 'mdz', 'new_host_2', 'NEW HOST2'), ('e_rara', 'x', 'erara', 'ERARA'), ('hathitrust', '', 'hathi', 'HATHI'), ('gallica', '', 'gallica', 'GAL')) t(preferred, by_url, slug, abbreviation)")
def provider_names(spark, sf_dir):
    rows = spark.createDataFrame([("bnf_gallica", None), ("", "internet_archive"), (None, None), ("New Host2", "mdz"), ("e_rara", "x"), ("hathitrust", ""), ("gallica", "")], "preferred string, by_url string")
    return rows.select("preferred", "by_url", text.provider_slug(F.col("preferred"), F.col("by_url")).alias("slug"), F.nullif(text.provider_abbreviation(F.col("preferred")), F.lit("")).alias("abbreviation"))


@query("SELECT entry_id, provider_key, source_id, total FROM (SELECT * FROM scored WHERE title_score >= 40 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY priority, total DESC, provider_ix, hit_ix) = 1) WHERE provider_key IN ('src3', 'src7', 'src2')", *ALL)
def selected_known(spark, sf_dir):
    """A work whose best candidate is of an unknown provider has no selection."""
    best = sel.select_best(lower_bound_scores(spark, sf_dir), "entry_id", F.col("title_score") >= GATE)
    known = spark.createDataFrame([("src3",), ("src7",), ("src2",)], "provider_key string")
    return sel.known_only(best, known).select("entry_id", "provider_key", "source_id", "total")


@query("SELECT id, title FROM queue WHERE status IN ('pending', 'retrying') ORDER BY CAST(substr(id, 2) AS BIGINT) LIMIT 10", QUEUE)
def queue_first(spark, sf_dir):
    return dq.first_waiting(queue(spark, sf_dir).withColumn("_ix", F.substring("id", 2, 20).cast("long")), "_ix").select("id", "title")


@query("SELECT provider_key, count(*) AS n, count(*) FILTER (WHERE status IN ('pending', 'retrying')) AS waiting FROM queue GROUP BY 1", QUEUE)
def queue_by_provider(spark, sf_dir):
    return dq.by_provider(queue(spark, sf_dir))


@query("SELECT DISTINCT entry_id FROM statused WHERE status = 'completed'", LEDGER, f"statused AS (SELECT *, {STATUS_SQL} AS status FROM ledger)")
def completed_ids(spark, sf_dir):
    return lg.completed_entries(ledger(spark, sf_dir))


@query("SELECT k, attempt, kind FROM (SELECT l_orderkey AS k, kind, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY r, n) AS INTEGER) AS attempt FROM (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS n, CASE l_partkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'slow' WHEN 2 THEN 'mirror' END AS kind, l_partkey % 4 AS r FROM lineitem) WHERE kind IS NOT NULL) WHERE attempt <= 5")
def link_attempts(spark, sf_dir):
    """Five links of a record at most, direct before slow before mirror."""
    p = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1_000_000 + p).alias("n"), F.when(p % 4 == 0, "direct").when(p % 4 == 1, "slow").when(p % 4 == 2, "mirror").otherwise("ad").alias("kind"))
    return dl.link_attempts(rows, "k", "kind", "n").select("k", "attempt", "kind")


@query("SELECT o_orderkey AS k, 'a' || o_orderkey || '|b|b c' AS parts FROM orders")
def split_lists(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = F.concat(F.lit(" a"), k, F.lit(",, b ,a"), k, F.lit("\n,b c,\tb,"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(text.split_list(cell), "|").alias("parts"))


@query("SELECT c_custkey AS k, 'The Old Mill ' || c_custkey || '|Another' AS titles FROM customer")
def title_candidates(spark, sf_dir):
    """Scraped titles once each by normal form; digests and link texts go."""
    k = F.col("c_custkey")
    texts = F.array(F.lit("Download"), F.concat(F.lit("The  Old\nMill "), k), F.concat(F.lit("the old MILL, "), k), F.md5(k.cast("string")), F.lit("ab"), F.lit(None).cast("string"), F.lit("Another"), F.lit("ANOTHER!"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(text.title_candidates(texts), "|").alias("titles"))


@query("SELECT doc_id, translate(lower(text), 'áéíóúüñ', 'aeiouun') AS folded FROM documents")
def spanish_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_spanish(F.col("text")).alias("folded"))


@query("SELECT id, strftime(coalesce(try_cast(reset_time AS TIMESTAMP), TIMESTAMP '2024-01-15 13:00:00'), '%Y-%m-%d %H:%M:%S') AS retry_at FROM queue", QUEUE)
def retry_times(spark, sf_dir):
    return queue(spark, sf_dir).select("id", F.date_format(dq.retry_at(dates.instant(F.col("reset_time")), now()), "yyyy-MM-dd HH:mm:ss").alias("retry_at"))


SIZES = [("1.5", 1_572_864, 1_610_612_736), ("0", None, None), ("-2", None, None), ("x", None, None), ("3", 3_145_728, 3_221_225_472)]


@query("SELECT o_orderkey AS k, " + ", ".join(f"CAST(CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {'NULL' if s[c] is None else s[c]}" for i, s in enumerate(SIZES)) + f" END AS BIGINT) AS {n}" for c, n in ((1, "mb"), (2, "gb"))) + " FROM orders")
def size_limits(spark, sf_dir):
    v = of_kind([s[0] for s in SIZES], F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), payload.megabytes(v).alias("mb"), payload.gigabytes(v).alias("gb"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 's' || o_orderkey WHEN 1 THEN 'i' || o_orderkey WHEN 2 THEN 'a' || o_orderkey END AS source_id FROM orders")
def chosen_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 1, F.concat(F.lit('{"identifier":"i'), k, F.lit('","ark_id":"x"}'))).when(k % 4 == 2, F.concat(F.lit('{"identifier":"","ark_id":"a'), k, F.lit('"}'))).otherwise("{}")
    own = F.when(k % 4 == 0, F.concat(F.lit("s"), k)).when(k % 4 == 1, "")
    return table(spark, sf_dir, "orders").select(k.alias("k"), rec.chosen_source_id(own, F.try_parse_json(raw)).alias("source_id"))


@query("SELECT id, provider_key, title, CASE WHEN creator IS NULL THEN '' ELSE creator END AS creators, source_id FROM queue", QUEUE)
def queue_candidates(spark, sf_dir):
    q = queue(spark, sf_dir)
    # the id travels in the entry's place
    back = dq.as_candidate(q.withColumn("entry_id", F.col("id")))
    return back.select(F.col("entry_id").alias("id"), "provider_key", "title", F.array_join("creators", "|").alias("creators"), "source_id")


@query("SELECT page_id, octet_length(encode(html)) < 10000 OR octet_length(encode(html)) = 9103 OR page_id % 7 = 0 AS placeholder FROM pages WHERE html IS NOT NULL")
def placeholder_images(spark, sf_dir):
    """Stand-ins by size or digest."""
    p = table(spark, sf_dir, "pages").filter("html is not null")
    big = p.select("page_id", F.when(F.col("page_id") % 7 == 0, F.rpad(F.lit("known"), 20_000, ".")).otherwise(F.col("html")).cast("binary").alias("b"))
    digest = hashlib.md5(b"known".ljust(20_000, b".")).hexdigest()  # noqa: S324
    return big.select("page_id", payload.placeholder_image(F.col("b"), [digest]).alias("placeholder"))


@query("SELECT entry_id, provider_key, CASE WHEN coalesce(iiif_manifest, '') <> '' THEN 'manifest' ELSE 'identifier' END AS route FROM hits", *ALL[:3])
def download_routes(spark, sf_dir):
    from .views import hits

    return dl.reachable(hits(spark, sf_dir)).select("entry_id", "provider_key", "route")


@query("SELECT 'e' || c_custkey AS entry_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(1600 + c_custkey % 400 AS INTEGER) END AS year FROM customer")
def row_years(spark, sf_dir):
    """The year of the cell called year in any case."""
    from ..sources.works import year_column

    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("e"), k).alias("entry_id"), F.when(k % 2 == 0, F.concat(F.lit("c. "), 1600 + k % 400)).otherwise("undated").alias("YeaR"))
    return rows.select("entry_id", dates.extract_year(year_column(rows)).alias("year"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'completed' END AS marker, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS exit_code FROM orders")
def completeness_markers(spark, sf_dir):
    from ..operators.audit import completeness_marker
    from ..operators.batch import exit_code

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), completeness_marker(F.lit(2), (k % 3).cast("int")).alias("marker"), exit_code((k % 2).cast("int")).alias("exit_code"))


@query(
    """SELECT '{"command":"batch","processed":' || (s + f + d + k) || ',"succeeded":' || s || ',"failed":' || f || ',"deferred":' || d || ',"skipped":' || k || ',"dry_run":false}' AS summary FROM (
      SELECT count(*) FILTER (WHERE outcome = 'success') AS s, count(*) FILTER (WHERE outcome = 'failed') AS f, count(*) FILTER (WHERE outcome = 'deferred') AS d, count(*) FILTER (WHERE outcome = 'skipped') AS k FROM outcomes WHERE outcome <> 'no_match')""",
    OUTCOMES,
)
def summary_line(spark, sf_dir):
    from ..operators.batch import summary

    return summary(outcomes(spark, sf_dir).filter("outcome <> 'no_match'"), "batch", dry_run=False)


@query("SELECT provider FROM (VALUES ('annas_archive'), ('bne'), ('british_library'), ('ddb'), ('dpla'), ('e_rara'), ('europeana'), ('gallica'), ('google_books'), ('hathitrust'), ('internet_archive'), ('loc'), ('mdz'), ('polona'), ('sbb_digital'), ('slub'), ('wellcome')) t(provider) ORDER BY provider")
def provider_list(spark, sf_dir):
    from ..functions.ids import host_table

    return host_table(spark).select(F.col("provider_key").alias("provider")).distinct().orderBy("provider")


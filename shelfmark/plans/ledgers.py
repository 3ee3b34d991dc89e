"""Queries over works tables, ledgers, the deferred queue and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import audit as audit_ops
from ..operators import ledger as lg
from ..operators import queue as dq
from ..operators import verify as vf
from .registry import query
from .views import BLANK, LEDGER, OUTCOMES, STATUS_SQL, ledger, outcomes, table

MANIFEST = f"(regexp_matches(trim({{0}}, {BLANK}), '^https?://') AND regexp_matches(trim({{0}}, {BLANK}), '(?i)/manifest$|/iiif/presentation/|api\\.digitale-sammlungen\\.de/iiif/presentation'))"
DIRECT = f"CASE WHEN {MANIFEST.format('direct_link')} THEN trim(direct_link, {BLANK}) WHEN {MANIFEST.format('link')} THEN trim(link, {BLANK}) END"
S = f"statused AS (SELECT *, {STATUS_SQL} AS status FROM ledger)"


@query(f"SELECT entry_id, direct FROM (SELECT *, {DIRECT} AS direct FROM ledger) WHERE trim(entry_id) <> '' AND (trim(short_title, {BLANK}) <> '' OR direct IS NOT NULL)", LEDGER)
def works_validate(spark, sf_dir):
    return lg.parsed_works(ledger(spark, sf_dir)).select("entry_id", "direct")


@query("SELECT entry_id, status FROM statused", LEDGER, S)
def status_parse(spark, sf_dir):
    return ledger(spark, sf_dir).select("entry_id", lg.parse_status(F.col("retrievable")).alias("status"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'pending') AS pending FROM statused", LEDGER, S)
def status_counts(spark, sf_dir):
    return lg.status_counts(ledger(spark, sf_dir))


@query("SELECT entry_id FROM statused WHERE status <> 'completed'", LEDGER, S)
def pending_rows(spark, sf_dir):
    return lg.pending(ledger(spark, sf_dir)).select("entry_id")


@query("SELECT entry_id FROM statused WHERE status = 'pending' ORDER BY _row_ix LIMIT 100", LEDGER, S)
def pending_new(spark, sf_dir):
    return lg.first_rows(lg.pending(ledger(spark, sf_dir), "new"), 100).select("entry_id")


@query("SELECT entry_id FROM statused WHERE status = 'failed'", LEDGER, S)
def pending_failed(spark, sf_dir):
    return lg.pending(ledger(spark, sf_dir), "failed").select("entry_id")


@query(f"SELECT entry_id FROM (SELECT * FROM ledger WHERE entry_id IN (SELECT entry_id FROM outcomes) ORDER BY _row_ix LIMIT 500) WHERE trim(short_title, {BLANK}) <> ''", LEDGER, OUTCOMES)
def entry_id_semi(spark, sf_dir):
    """The limit counts rows with blank titles, which go only after it."""
    rows = lg.first_rows(lg.only_entries(ledger(spark, sf_dir), outcomes(spark, sf_dir)), 500)
    return rows.filter(~lg.blank(F.col("short_title"))).select("entry_id")


AUDIT = "audit AS (SELECT entry_id, CASE WHEN bool_or(outcome = 'success') THEN 'completed' ELSE 'failed' END AS status, count(*) FILTER (WHERE outcome IN ('success', 'skipped')) AS n_objects FROM outcomes GROUP BY 1)"


def audit(spark, sf_dir):
    o = F.col("outcome")
    return outcomes(spark, sf_dir).groupBy("entry_id").agg(F.when(F.bool_or(o == "success"), "completed").otherwise("failed").alias("status"), F.count_if(o.isin("success", "skipped")).alias("n_objects"))


@query("SELECT entry_id FROM ledger WHERE entry_id NOT IN (SELECT entry_id FROM audit WHERE status = 'completed')", LEDGER, OUTCOMES, AUDIT)
def resume_anti(spark, sf_dir):
    return lg.without_finished(ledger(spark, sf_dir), audit(spark, sf_dir)).select("entry_id")


@query("SELECT entry_id FROM ledger WHERE entry_id NOT IN (SELECT entry_id FROM audit WHERE n_objects > 0)", LEDGER, OUTCOMES, AUDIT)
def resume_with_objects(spark, sf_dir):
    return lg.without_finished(ledger(spark, sf_dir), audit(spark, sf_dir), "skip_if_has_objects").select("entry_id")


@query("SELECT entry_id, CASE WHEN entry_id IN (SELECT entry_id FROM audit WHERE status = 'completed') THEN 'skipped' ELSE 'no_match' END AS label FROM statused WHERE status = 'pending'", LEDGER, S, OUTCOMES, AUDIT)
def unfinished_labels(spark, sf_dir):
    left_out = lg.pending(ledger(spark, sf_dir), "new").select("entry_id")
    return lg.unfinished_labels(left_out, audit(spark, sf_dir).filter("status = 'completed'"))


@query("SELECT *, greatest(0, failed - deferred) + skipped + no_match AS parallel_failed FROM (SELECT count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'deferred') AS deferred, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'no_match') AS no_match FROM outcomes)", OUTCOMES)
def batch_outcomes(spark, sf_dir):
    counts = lg.outcome_counts(outcomes(spark, sf_dir))
    return counts.withColumn("parallel_failed", lg.parallel_failed(F.col("failed"), F.col("deferred"), F.col("skipped"), F.col("no_match")))


LAST = "last_event AS (SELECT * FROM outcomes WHERE outcome IN ('success', 'failed', 'deferred') QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ts DESC, seq DESC) = 1)"


@query(
    """SELECT entry_id, CASE WHEN e.outcome = 'success' THEN 'True' WHEN e.outcome = 'failed' THEN 'False' WHEN e.outcome = 'deferred' THEN 'deferred' ELSE retrievable END AS retrievable,
      CASE WHEN e.outcome = 'success' THEN e.item_url ELSE link END AS link, CASE WHEN e.outcome = 'success' THEN e.provider END AS download_provider,
      CASE WHEN e.outcome = 'success' THEN strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') END AS download_timestamp
    FROM ledger LEFT JOIN last_event e USING (entry_id)""",
    LEDGER, OUTCOMES, LAST,
)
def status_update(spark, sf_dir):
    events = outcomes(spark, sf_dir).filter(F.col("outcome").isin("success", "failed", "deferred")).select("entry_id", "ts", "seq", "outcome", "item_url", "provider")
    return lg.apply_status(ledger(spark, sf_dir), events).select("entry_id", "retrievable", "link", "download_provider", "download_timestamp")


INDEX = """
idx AS (SELECT CAST(o_custkey % 500 AS VARCHAR) AS work_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS VARCHAR) END AS entry_id, o_orderstatus AS status, o_orderkey AS _row_ix FROM orders),
idx_new AS (SELECT CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(user_id % 600 AS VARCHAR) END AS work_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 300 AS VARCHAR) END AS entry_id, event_type AS status, event_id AS _row_ix FROM events)"""


@query(
    """SELECT coalesce(n.status, o.status) AS status, coalesce(o.work_id, n.work_id) AS work_id, coalesce(CASE WHEN n.status IS NOT NULL THEN n.entry_id ELSE o.entry_id END, '') AS entry_id, o._row_ix AS row_ix
    FROM (SELECT *, row_number() OVER (PARTITION BY work_id, coalesce(entry_id, '') ORDER BY _row_ix) AS n FROM idx) o
    FULL JOIN (SELECT * FROM idx_new WHERE work_id <> '' QUALIFY row_number() OVER (PARTITION BY work_id, entry_id ORDER BY _row_ix DESC) = 1) n
    ON o.n = 1 AND o.work_id = n.work_id AND coalesce(o.entry_id, '') = n.entry_id
    UNION ALL SELECT status, work_id, entry_id, _row_ix FROM idx_new WHERE work_id = ''""",
    INDEX,
)
def index_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select((F.col("o_custkey") % 500).cast("string").alias("work_id"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 300).cast("string")).alias("entry_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("_row_ix"))
    e = table(spark, sf_dir, "events")
    new = e.select(F.when(F.col("event_id") % 10 == 0, "").otherwise((F.col("user_id") % 600).cast("string")).alias("work_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 300).cast("string")).alias("entry_id"), F.col("event_type").alias("status"), F.col("event_id").alias("_row_ix"))
    out = lg.upsert(old, new, ["work_id", "entry_id"], "_row_ix", append_if_blank="work_id")
    return out.select("status", "work_id", F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.col("_row_ix").alias("row_ix"))


@query(
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS segment FROM customer"""
)
def index_presence_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    none = F.lit(None).cast("string")
    cells = F.when(F.col("key") % 3 == 0, F.create_map(F.lit("name"), F.lit("new"), F.lit("segment"), none)).when(F.col("key") % 3 == 1, F.create_map(F.lit("segment"), none))
    updates = c.select("key", cells.alias("cells")).filter("cells is not null")
    return lg.merge_present(c, updates, "key", ["name", "segment"])


NOW = "2024-01-15 12:00:00"
QUEUE = """
queue AS (
  SELECT 'q' || event_id AS id, CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS entry_id, 't' || user_id AS title, CASE WHEN event_id % 2 = 0 THEN 'c' || user_id END AS creator, 'p' || (event_id % 4) AS provider_key,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 's' || (event_id % 7) END AS source_id,
    CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'retrying' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
    CAST(event_id % 6 AS INTEGER) AS retry_count, CASE WHEN event_id % 8 = 0 THEN 'soon' WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS reset_time,
    CASE WHEN event_id % 11 = 0 THEN 'x' ELSE strftime(ts - INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S') END AS deferred_at FROM events)"""


def queue(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), i).alias("id"),
        F.when(i % 6 == 0, "").otherwise(F.col("user_id").cast("string")).alias("entry_id"),
        F.concat(F.lit("t"), F.col("user_id")).alias("title"),
        F.when(i % 2 == 0, F.concat(F.lit("c"), F.col("user_id"))).alias("creator"),
        F.concat(F.lit("p"), i % 4).alias("provider_key"),
        F.when(i % 5 != 0, F.concat(F.lit("s"), i % 7)).alias("source_id"),
        F.when(kind == "view", "retrying").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending").alias("status"),
        (i % 6).cast("int").alias("retry_count"),
        F.when(i % 8 == 0, "soon").when(i % 9 != 0, F.date_format("ts", iso)).alias("reset_time"),
        F.when(i % 11 == 0, "x").otherwise(F.date_format(F.col("ts") - F.expr("interval 2 days"), iso)).alias("deferred_at"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT status, count(*) AS n, CAST(sum(retry_count) AS BIGINT) AS retries FROM queue GROUP BY 1", QUEUE)
def queue_counts(spark, sf_dir):
    return dq.counts(queue(spark, sf_dir))


@query(f"SELECT id FROM queue WHERE status IN ('pending', 'retrying') AND (try_cast(reset_time AS TIMESTAMP) IS NULL OR try_cast(reset_time AS TIMESTAMP) <= TIMESTAMP '{NOW}')", QUEUE)
def queue_ready(spark, sf_dir):
    return queue(spark, sf_dir).filter(dq.ready(now())).select("id")


@query(f"SELECT id FROM queue WHERE NOT (status IN ('completed', 'failed') AND (try_cast(deferred_at AS TIMESTAMP) IS NULL OR try_cast(deferred_at AS TIMESTAMP) < TIMESTAMP '{NOW}' - INTERVAL 7 DAY))", QUEUE)
def queue_cleanup(spark, sf_dir):
    return queue(spark, sf_dir).filter(~dq.outdated(now())).select("id")


@query("SELECT id, CASE WHEN retry_count + 1 >= 5 THEN 'failed' ELSE 'retrying' END AS status, retry_count + 1 AS retry_count FROM queue", QUEUE)
def queue_retry(spark, sf_dir):
    status, n = dq.retried(F.col("status"), F.col("retry_count"))
    return queue(spark, sf_dir).select("id", status.alias("status"), n.alias("retry_count"))


@query("SELECT strftime(min(try_cast(reset_time AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS next_ready FROM queue WHERE status IN ('pending', 'retrying')", QUEUE)
def next_reset(spark, sf_dir):
    return dq.next_ready(queue(spark, sf_dir)).select(F.date_format("next_ready", "yyyy-MM-dd HH:mm:ss").alias("next_ready"))


@query("SELECT id FROM queue WHERE (entry_id, title) IN (SELECT CAST(c_custkey AS VARCHAR), 't' || c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')", QUEUE)
def deferred_ownership(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("entry_id"), F.concat(F.lit("t"), F.col("c_custkey")).alias("short_title"))
    return dq.owned(queue(spark, sf_dir), c).select("id")


DEDUPE = """
old AS (SELECT * FROM queue WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0),
new AS (SELECT * FROM queue WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 1),
firsts AS (SELECT *, last_value(reset_time) OVER w AS last_reset, row_number() OVER (PARTITION BY entry_id, provider_key, coalesce(source_id, '') ORDER BY CAST(substr(id, 2) AS BIGINT)) AS n
  FROM new WHERE entry_id <> '' WINDOW w AS (PARTITION BY entry_id, provider_key, coalesce(source_id, '') ORDER BY CAST(substr(id, 2) AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    """SELECT o.id, coalesce(f.last_reset, o.reset_time) AS reset_time FROM old o LEFT JOIN (SELECT * FROM firsts WHERE n = 1) f
      ON o.status IN ('pending', 'retrying') AND o.entry_id = f.entry_id AND o.provider_key = f.provider_key AND coalesce(o.source_id, '') = coalesce(f.source_id, '')
    UNION ALL SELECT id, last_reset FROM firsts f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.status IN ('pending', 'retrying') AND o.entry_id = f.entry_id AND o.provider_key = f.provider_key AND coalesce(o.source_id, '') = coalesce(f.source_id, ''))
    UNION ALL SELECT id, reset_time FROM new WHERE entry_id = ''""",
    QUEUE, DEDUPE,
)
def deferred_dedupe(spark, sf_dir):
    q = queue(spark, sf_dir).withColumn("_ix", F.substring("id", 2, 20).cast("long"))
    old, new = q.filter("_ix % 2 = 0").drop("_ix"), q.filter("_ix % 2 = 1")
    return dq.add_deferred(old, new, "_ix").select("id", "reset_time")


QUOTAS = """
quotas AS (SELECT 'p' || user_id AS provider_key, CAST(60 + user_id % 20 AS INTEGER) AS daily_limit, 24 + user_id % 3 AS reset_hours, CAST(count(*) AS INTEGER) AS downloads_used,
  CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE strftime(TIMESTAMP '2024-01-14 18:00:00' + to_minutes(user_id * 10), '%Y-%m-%dT%H:%M:%S') END AS period_start FROM events GROUP BY user_id),
viewed AS (SELECT *, try_cast(period_start AS TIMESTAMP) AS b, try_cast(period_start AS TIMESTAMP) + to_hours(CAST(reset_hours AS BIGINT)) AS reset_at FROM quotas),
state AS (SELECT *, b IS NULL OR TIMESTAMP '2024-01-15 12:00:00' >= reset_at OR TIMESTAMP '2024-01-15 12:00:00' < b AS expired FROM viewed),
quota AS (SELECT *, NOT expired AND downloads_used >= daily_limit AS exhausted FROM state)"""


def quotas(spark, sf_dir):
    u = F.col("user_id")
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-14 18:00:00").cast("timestamp")) + u * 600)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("downloads_used")).select(
        F.concat(F.lit("p"), u).alias("provider_key"), (60 + u % 20).cast("int").alias("daily_limit"), (24 + u % 3).alias("reset_hours"), "downloads_used",
        F.when(u % 7 == 0, "unknown").otherwise(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss")).alias("period_start"),
    )


@query("SELECT provider_key, expired, exhausted, CASE WHEN exhausted THEN CAST(epoch(reset_at) - epoch(TIMESTAMP '2024-01-15 12:00:00') AS BIGINT) ELSE 0 END AS seconds_left FROM quota", QUOTAS)
def quota_status(spark, sf_dir):
    return dq.quota_view(quotas(spark, sf_dir), now()).select("provider_key", "expired", "exhausted", F.col("seconds_left").cast("long"))


@query("SELECT provider_key, row_number() OVER (ORDER BY reset_at, provider_key) = 1 AS is_next FROM quota WHERE exhausted", QUOTAS)
def exhausted_providers(spark, sf_dir):
    return dq.exhausted_providers(quotas(spark, sf_dir), now()).select("provider_key", "is_next")


@query("SELECT event_id, CAST(least(1.5 * pow(1.5, event_id % 12), 60.0) AS DOUBLE) AS wait FROM events")
def backoff_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.backoff(F.col("event_id") % 12 + 1, 1.5, 1.5, 60.0).alias("wait"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN greatest(0.0, least(100.0, event_id % 150 - 10)) WHEN event_id % 3 = 1 THEN 60.0 END AS DOUBLE) AS wait FROM events")
def retry_after(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 150 - 10).cast("string")).when(F.col("event_id") % 3 == 1, "Mon, 15 Jan 2024 12:01:00 GMT").otherwise("later")
    return e.select("event_id", dates.retry_after(header, now(), 100.0).alias("wait"))


@query(
    """WITH i AS (SELECT path, max(status) AS status FROM (SELECT CASE WHEN o_custkey % 4 = 0 THEN '/W/' ELSE '/w/' END || o_custkey AS path, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE '' END END AS status FROM orders) WHERE status <> 'failed' GROUP BY 1),
    f AS (SELECT path, max(status) AS status FROM (SELECT '/w/' || (user_id * 13) AS path, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'deferred' ELSE 'no_candidates' END AS status FROM events) WHERE status <> 'deferred' GROUP BY 1)
    SELECT path, status, 'index' AS origin FROM i UNION ALL SELECT path, status, 'folder' FROM f WHERE path NOT IN (SELECT path FROM i)"""
)
def verify_union(spark, sf_dir):
    s = F.col("o_orderstatus")
    index = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_custkey") % 4 == 0, "/W/").otherwise("/w/"), F.col("o_custkey")).alias("work_dir"), F.when(s == "F", "\tCompleted\n").when(s == "O", "partial").when(F.col("o_orderkey") % 2 == 0, "failed").alias("status"))
    folders = table(spark, sf_dir, "events").select(F.concat(F.lit("/w/"), F.col("user_id") * 13).alias("work_dir"), F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "deferred").otherwise("no_candidates").alias("status"))
    return vf.works_to_verify(index, folders)


FILES = """
files AS (SELECT l_orderkey AS k, 'f' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN '.pdf' ELSE '.jpg' END AS name, CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE l_partkey END AS length, CASE WHEN l_suppkey % 11 = 0 THEN '<html' ELSE '%PDF-1' END AS head FROM lineitem),
checked AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no objects' WHEN empty > 0 THEN 'empty file' WHEN wrong THEN 'PDF contains HTML' WHEN o_orderkey % 8 > n THEN 'missing pages' END AS reason FROM orders LEFT JOIN (
  SELECT k, count(*) AS n, count(*) FILTER (WHERE length = 0) AS empty, bool_or(name LIKE '%.pdf' AND head = '<html') AS wrong FROM files GROUP BY k) ON k = o_orderkey)"""


def checked(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("f"), F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 == 0, ".PDF").otherwise(".jpg"))
    files = li.select(F.col("l_orderkey").alias("o_orderkey"), name.alias("name"), F.when(F.col("l_partkey") % 97 == 0, 0).otherwise(F.col("l_partkey")).alias("length"), F.when(F.col("l_suppkey") % 11 == 0, "<html").otherwise("%PDF-1").cast("binary").alias("head"))
    works = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("pages_expected"))
    return vf.verdicts(works, files, "o_orderkey")


@query("SELECT o_orderkey, reason IS NULL AS ok, reason FROM checked", FILES)
def verify_works(spark, sf_dir):
    return checked(spark, sf_dir)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS ok, count(*) FILTER (WHERE reason IS NOT NULL) AS partial FROM checked", FILES)
def verify_totals(spark, sf_dir):
    return vf.verdict_totals(checked(spark, sf_dir))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'completed' END AS status, CAST(o_orderkey AS VARCHAR) AS entry_id, 'a"' || o_clerk AS title, '2024-01-15T12:00:00Z' AS updated_at, CAST(o_custkey AS BIGINT) AS pages,
      2 AS n_candidates, 1.5::DOUBLE AS first_score, CASE WHEN o_orderkey % 2 = 0 THEN TRUE END AS kept, '[1,2]' AS files, FALSE AS unfinished
    FROM (SELECT *, CAST(o_orderpriority AS VARCHAR) AS o_clerk FROM orders)"""
)
def document_status(spark, sf_dir):
    """Work documents after a change of status: nested cells keep their values and kinds."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    candidates = F.array(F.struct(F.lit("x").alias("provider"), F.struct(F.lit(1.5).alias("total")).alias("scores")), F.struct(F.lit("y").alias("provider"), F.struct(F.lit(2.5).alias("total")).alias("scores")))
    given = F.struct(k.cast("string").alias("entry_id"), F.concat(F.lit('a"'), "o_orderpriority").alias("title"))
    old = F.to_json(F.struct(given.alias("input"), F.lit("pending").alias("status"), F.lit("2023").alias("updated_at"), F.col("o_custkey").alias("pages"), candidates.alias("candidates"), F.when(k % 2 == 0, True).alias("kept")))
    docs = o.select(k.alias("k"), old.alias("document"))
    status = F.when(F.col("k") % 5 == 0, "partial").otherwise("completed")
    new = audit_ops.changed_status(docs, status, now(), {"files": F.array(F.lit(1), F.lit(2))})
    v = F.parse_json("document")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    left = audit_ops.unfinished(new).select(F.col("k").alias("_k"))
    out = new.join(left, F.col("k") == F.col("_k"), "left")
    return out.select(
        "k", at("$.status", "string").alias("status"), at("$.input.entry_id", "string").alias("entry_id"), at("$.input.title", "string").alias("title"), at("$.updated_at", "string").alias("updated_at"), at("$.pages", "bigint").alias("pages"),
        F.size(at("$.candidates", "array<variant>")).alias("n_candidates"), at("$.candidates[0].scores.total", "double").alias("first_score"), at("$.kept", "boolean").alias("kept"), F.get_json_object("document", "$.files").alias("files"), F.col("_k").isNotNull().alias("unfinished"),
    )

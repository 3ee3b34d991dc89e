"""Queries over order-dependent machines: breaker, limiter, quota, budget, runs of failures, file numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as st
from .registry import query
from .views import table


def requests(spark, sf_dir):
    """Events as provider requests: a number of 12 providers, one of them null, seconds since the first day, and an outcome."""
    e = table(spark, sf_dir, "events")
    t = F.round(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6, 3)
    return e.select("event_id", F.nullif(F.col("user_id") % 12, F.lit(7)).alias("provider"), t.alias("t"), (F.col("event_type") != "error").alias("ok"))


REQUESTS = "requests AS (SELECT event_id, nullif(user_id % 12, 7) AS provider, round((epoch_us(ts) - 1704067200000000) / 1e6, 3) AS t, event_type <> 'error' AS ok FROM events)"


@query("SELECT provider, run, count(*) AS length, min(t) AS first, max(t) AS last FROM (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM requests) WHERE NOT ok GROUP BY 1, 2", REQUESTS)
def failure_islands(spark, sf_dir):
    return st.islands(requests(spark, sf_dir), "provider", ["t", "event_id"], ~F.col("ok"))


@query("SELECT event_id, round(started, 3) AS started, round(started - t, 3) AS waited FROM (SELECT *, max(t - n * 400.0) OVER (PARTITION BY provider ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + n * 400.0 AS started FROM (SELECT *, CAST(row_number() OVER (PARTITION BY provider ORDER BY t, event_id) AS DOUBLE) AS n FROM requests))", REQUESTS)
def limiter_fold(spark, sf_dir):
    out = st.limiter(requests(spark, sf_dir), "provider", "t", "event_id", 400.0)
    return out.select("event_id", F.round("started", 3).alias("started"), F.round("waited", 3).alias("waited"))


# one row after the other within each provider, as the folds do
CHAIN = f"""WITH RECURSIVE {REQUESTS.strip()},
chain AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY t, event_id) AS n FROM requests),
"""


@query(
    CHAIN
    + """walk AS (
  SELECT provider, n, event_id, TRUE AS admitted, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(0.0 AS DOUBLE) AS since FROM chain WHERE n = 1
  UNION ALL
  SELECT provider, n, event_id, admitted,
    CASE WHEN NOT admitted THEN 'open' WHEN ok THEN 'closed' WHEN was_open OR before + 1 >= 3 THEN 'open' ELSE 'closed' END,
    CASE WHEN NOT admitted THEN before WHEN ok THEN 0 ELSE before + 1 END,
    CASE WHEN NOT admitted THEN since WHEN ok THEN 0.0 WHEN was_open OR before + 1 >= 3 THEN t ELSE since END
  FROM (SELECT c.provider, c.n, c.event_id, c.t, c.ok, w.failures AS before, w.since, w.state = 'open' AS was_open, w.state <> 'open' OR c.t - w.since >= 3000.0 AS admitted
    FROM walk w JOIN chain c ON c.provider IS NOT DISTINCT FROM w.provider AND c.n = w.n + 1))
SELECT event_id, provider, admitted, state, CAST(failures AS INTEGER) AS failures FROM walk"""
)
def breaker_fold(spark, sf_dir):
    return st.breaker(requests(spark, sf_dir), "provider", "t", "event_id", "ok", 3, 3000.0).select("event_id", "provider", "admitted", "state", "failures")


@query(
    CHAIN
    + """walk AS (
  SELECT provider, n, event_id, TRUE AS allowed, 1 AS used, t AS begun FROM chain WHERE n = 1
  UNION ALL
  SELECT provider, n, event_id, rolled OR used < 10, CASE WHEN rolled THEN 1 WHEN used < 10 THEN used + 1 ELSE used END, CASE WHEN rolled THEN t ELSE begun END
  FROM (SELECT c.provider, c.n, c.event_id, c.t, w.used, w.begun, c.t < w.begun OR c.t - w.begun >= 86400 AS rolled FROM walk w JOIN chain c ON c.provider IS NOT DISTINCT FROM w.provider AND c.n = w.n + 1))
SELECT event_id, provider, allowed, CAST(used AS INTEGER) AS used FROM walk"""
)
def quota_fold(spark, sf_dir):
    return st.quota(requests(spark, sf_dir), "provider", "t", "event_id", 10, 24).select("event_id", "provider", "allowed", "used")


PAID = "items AS (SELECT c_custkey AS ix, c_nationkey AS work, c_mktsegment AS kind, CAST(trunc(abs(c_acctbal)) AS BIGINT) + 1 AS size FROM customer)"


@query(
    f"""WITH RECURSIVE {PAID},
    chain AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ix) AS n FROM items),
    limits AS (SELECT * FROM (VALUES ('BUILDING', 20000, 150000), ('MACHINERY', 9000, NULL), ('HOUSEHOLD', NULL, 400000)) t(kind, per_work, total)),
    walk AS (
      SELECT kind, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ix, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS used, list_transform(range(25), lambda x: CAST(0 AS BIGINT)) AS held FROM (SELECT DISTINCT kind FROM chain)
      UNION ALL
      SELECT kind, n, ix, ok, CASE WHEN ok THEN used + size ELSE used END, [CASE WHEN ok AND i = work + 1 THEN x + size ELSE x END for x, i in held]
      FROM (SELECT c.kind, c.n, c.ix, c.size, c.work, w.used, w.held, (l.total IS NULL OR w.used + c.size <= l.total) AND (l.per_work IS NULL OR w.held[c.work + 1] + c.size <= l.per_work) AS ok
        FROM walk w JOIN chain c ON c.kind = w.kind AND c.n = w.n + 1 LEFT JOIN limits l ON l.kind = c.kind))
    SELECT ix, ok AS admitted FROM walk WHERE n > 0"""
)
def budget_fold(spark, sf_dir):
    """Refused items are skipped; two kinds have a limit on their total."""
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("ix"), F.col("c_nationkey").alias("work"), F.col("c_mktsegment").alias("kind"), (F.abs("c_acctbal").cast("long") + 1).alias("size"))
    return st.budget(items, "work", "kind", "size", "ix", {"BUILDING": 20_000, "MACHINERY": 9000}, {"BUILDING": 150_000, "HOUSEHOLD": 400_000}).select("ix", "admitted")


LINES = """lines AS (SELECT work * 10 + line AS ix, work, kind, size FROM (
  SELECT l_orderkey AS work, l_linenumber AS line, min(l_returnflag) AS kind, CAST(sum(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2))"""


@query(
    f"""WITH RECURSIVE {LINES},
    chain AS (SELECT *, row_number() OVER (PARTITION BY work, kind ORDER BY ix) AS n FROM lines),
    limits AS (SELECT * FROM (VALUES ('A', 60000), ('R', 45000)) t(kind, per_work)),
    walk AS (
      SELECT c.work, c.kind, c.n, c.ix, c.size, l.per_work IS NULL OR c.size <= l.per_work AS ok, CASE WHEN l.per_work IS NULL OR c.size <= l.per_work THEN c.size ELSE 0 END AS used FROM chain c LEFT JOIN limits l USING (kind) WHERE n = 1
      UNION ALL
      SELECT work, kind, n, ix, size, ok, CASE WHEN ok THEN used + size ELSE used END FROM (
        SELECT c.work, c.kind, c.n, c.ix, c.size, w.used, l.per_work IS NULL OR w.used + c.size <= l.per_work AS ok FROM walk w JOIN chain c ON c.work = w.work AND c.kind = w.kind AND c.n = w.n + 1 LEFT JOIN limits l ON l.kind = c.kind)),
    sums AS (SELECT *, coalesce(sum(CASE WHEN ok THEN size ELSE 0 END) OVER (PARTITION BY kind ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM walk),
    ended AS (SELECT min(ix) AS halt FROM sums WHERE kind = 'R' AND before + size > 50000000 OR kind = 'N' AND before + size > 900000000)
    SELECT ix, ok AND (halt IS NULL OR ix < halt) AS admitted FROM sums, ended"""
)
def budget_stop(spark, sf_dir):
    """The first item beyond a kind's total ends the run for every kind."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("kind"), F.sum(F.col("l_extendedprice").cast("long")).alias("size"))
    items = li.select((F.col("work") * 10 + F.col("line")).alias("ix"), "work", "kind", "size")
    return st.budget(items, "work", "kind", "size", "ix", {"A": 60_000, "R": 45_000}, {"R": 50_000_000, "N": 900_000_000}, stop=True).select("ix", "admitted")


@query("SELECT work, kind, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT l_orderkey AS work, l_returnflag AS kind, CAST(trunc(l_extendedprice) AS BIGINT) AS size FROM lineitem) GROUP BY 1, 2")
def budget_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").cast("long").alias("size"))
    return st.used_bytes(li, "work", "kind", "size")


@query(
    """SELECT c, turn FROM (SELECT *, min(CASE WHEN na >= 2 OR nb >= 3 THEN turn END) OVER (PARTITION BY c) AS stop FROM (
      SELECT *, sum(CAST(p AS INTEGER)) OVER (PARTITION BY c, ra ORDER BY turn ROWS UNBOUNDED PRECEDING) AS na, sum(CAST(f AS INTEGER)) OVER (PARTITION BY c, rb ORDER BY turn ROWS UNBOUNDED PRECEDING) AS nb FROM (
        SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER w AS ra, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER w AS rb FROM (
          SELECT conv_id AS c, turn, length(text) < 200 AS p, length(text) % 2 = 0 AS f FROM conversations) WINDOW w AS (PARTITION BY c ORDER BY turn ROWS UNBOUNDED PRECEDING))))
    WHERE stop IS NULL OR turn <= stop"""
)
def early_stop(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), "turn", (F.length("text") < 200).alias("p"), (F.length("text") % 2 == 0).alias("f"))
    return st.early_stop(t, "c", "turn", "p", "f", 2, 3).select("c", "turn")


@query(
    """SELECT k, CAST(seq AS INTEGER) AS seq, CASE WHEN kind = 'image' THEN stem || '_' || slug || '_image_' || lpad(CAST(seq AS VARCHAR), 3, '0') WHEN seq > 1 THEN stem || '_' || slug || '_' || seq ELSE stem || '_' || slug END || ext AS filename FROM (
      SELECT *, row_number() OVER (PARTITION BY work, stem, slug, kind ORDER BY k) AS seq FROM (
        SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS work, 'w' || l_orderkey || '_' || lower(l_linestatus) AS stem, 's' || (l_suppkey % 2) AS slug, CASE l_partkey % 3 WHEN 0 THEN '.pdf' ELSE '.jpg' END AS ext, CASE l_partkey % 3 WHEN 0 THEN 'pdf' ELSE 'image' END AS kind
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_partkey) OVER w AS l_partkey, first_value(l_suppkey) OVER w AS l_suppkey, first_value(l_linestatus) OVER w AS l_linestatus FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_linestatus, l_extendedprice))))"""
)
def file_sequence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_linestatus")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    files = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_orderkey").alias("work"), F.concat(F.lit("w"), F.col("l_orderkey"), F.lit("_"), F.lower("l_linestatus")).alias("stem"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 2).alias("slug"), F.when(F.col("l_partkey") % 3 == 0, ".pdf").otherwise(".jpg").alias("ext"),
    )
    return st.number_files(files, "work", "stem", "slug", "ext", "k").select("k", "seq", "filename")


@query("SELECT event_id, CASE WHEN c IN (401, 403) THEN 'failure' WHEN c IN (400, 404, 410, 422) OR c BETWEEN 200 AND 399 THEN 'success' WHEN c = 429 OR c BETWEEN 500 AND 599 THEN 'retry' ELSE 'failure' END AS outcome FROM (SELECT event_id, 390 + event_id % 130 AS c FROM events)")
def attempt_outcome(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", st.attempt_outcome(390 + F.col("event_id") % 130).alias("outcome"))

"""Views over the driver tables that queries and their SQL twins share.

``ledger`` is a works table over orders, ``outcomes`` are status events over events,
``works`` are wanted titles from benchmark texts, and ``hits`` are captured search hits:
sentences of documents that share three words in a row with a wanted title, numbered by
``hit_ix`` for each work and provider.  The SQL twin keeps five of each, and so do the
queries it is held against; the others take all.  The hits come from an equi-join on the three words, so their
number follows the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, with_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Blanks and line ends of Unicode in SQL.
BLANK = "'\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'"
LEDGER = """
ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, o_orderkey AS _row_ix,
    CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 19 = 0 THEN chr(9) || chr(13) || chr(10) || chr(160) ELSE o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey END AS short_title,
    CASE WHEN o_orderkey % 13 = 3 THEN 'true' || chr(9) WHEN o_orderkey % 13 = 5 THEN chr(10) || 'FALSE' || chr(160) WHEN o_orderkey % 13 = 7 THEN '1d' ELSE CASE o_orderkey % 11 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN ' wahr ' WHEN 4 THEN 'Falsch' WHEN 5 THEN ''
      WHEN 7 THEN 'deferred' WHEN 8 THEN '1.0' WHEN 9 THEN '0.0' WHEN 10 THEN 'maybe' END END AS retrievable,
    CASE WHEN o_orderkey % 25 = 0 THEN chr(9) || 'https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb' || o_orderkey || '/manifest' || chr(13) || chr(10) ELSE CASE o_orderkey % 5 WHEN 0 THEN ' https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb' || o_orderkey || '/manifest ' WHEN 1 THEN 'https://example.org/' || o_orderkey END END AS direct_link,
    CASE o_orderkey % 7 WHEN 0 THEN 'https://host.example.org/iiif/' || o_orderkey || '/manifest' END AS link,
    CAST(NULL AS VARCHAR) AS download_provider, CAST(NULL AS VARCHAR) AS download_timestamp
  FROM orders
)"""
STATUS_SQL = f"""CASE WHEN lower(trim(retrievable, {BLANK})) IN ('true', '1', 'yes', 'y', 'wahr') THEN 'completed'
  WHEN lower(trim(retrievable, {BLANK})) IN ('false', '0', 'no', 'n', 'falsch') THEN 'failed'
  WHEN lower(trim(retrievable, {BLANK})) = 'deferred' THEN 'deferred'
  WHEN try_cast(lower(trim(retrievable, {BLANK})) AS DOUBLE) = 1 THEN 'completed'
  WHEN try_cast(lower(trim(retrievable, {BLANK})) AS DOUBLE) = 0 THEN 'failed' ELSE 'pending' END"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    marks = {0: "True", 1: "FALSE", 2: "1", 3: " wahr ", 4: "Falsch", 5: "", 7: "deferred", 8: "1.0", 9: "0.0", 10: "maybe"}
    mark = none
    for r, text in marks.items():
        mark = F.when(k % 11 == r, text).otherwise(mark)
    mark = F.when(k % 13 == 3, "true\t").when(k % 13 == 5, "\nFALSE\xa0").when(k % 13 == 7, "1d").otherwise(mark)
    link = F.when(k % 25 == 0, F.concat(F.lit("\thttps://api.digitale-sammlungen.de/iiif/presentation/v2/bsb"), k, F.lit("/manifest\r\n"))).when(k % 5 == 0, F.concat(F.lit(" https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb"), k, F.lit("/manifest "))).when(k % 5 == 1, F.concat(F.lit("https://example.org/"), k))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("entry_id"),
        k.alias("_row_ix"),
        F.when(k % 17 == 0, " ").when(k % 19 == 0, "\t\r\n\xa0").otherwise(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", k)).alias("short_title"),
        mark.alias("retrievable"),
        link.alias("direct_link"),
        F.when(k % 7 == 0, F.concat(F.lit("https://host.example.org/iiif/"), k, F.lit("/manifest"))).alias("link"),
        none.alias("download_provider"),
        none.alias("download_timestamp"),
    )


OUTCOMES = """
outcomes AS (
  SELECT CAST((event_id * 37 + user_id) % 20000 AS VARCHAR) AS entry_id, event_id AS seq, ts,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'deferred' WHEN 'view' THEN 'skipped' ELSE 'no_match' END AS outcome,
    'https://archive.org/details/i' || event_id AS item_url, 'p' || (user_id % 6) AS provider, user_id
  FROM events
)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "success").when(kind == "error", "failed").when(kind == "signup", "deferred").when(kind == "view", "skipped").otherwise("no_match")
    return table(spark, sf_dir, "events").select(
        ((F.col("event_id") * 37 + F.col("user_id")) % 20000).cast("string").alias("entry_id"),
        F.col("event_id").alias("seq"),
        "ts",
        outcome.alias("outcome"),
        F.concat(F.lit("https://archive.org/details/i"), F.col("event_id")).alias("item_url"),
        F.concat(F.lit("p"), F.col("user_id") % 6).alias("provider"),
        "user_id",
    )


def norm_sql(x: str) -> str:
    """The matching key of text without letters beyond Latin."""
    out = f"lower(strip_accents({x}))"
    for a, b in (("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("œ", "oe"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^0-9a-z]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"


WORKS = f"""
works AS (
  SELECT *, {norm_sql("short_title")} AS norm FROM (
    SELECT lpad(CAST(item_id AS VARCHAR), 5, '0') AS entry_id, item_id, trim(regexp_extract(text, '^[^.!?\n]*', 0), ' ') AS short_title,
      split_part(text, ' ', 2) AS main_author, CAST(1600 + item_id * 7 % 400 AS INTEGER) AS query_year
    FROM benchmark)
)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    out = table(spark, sf_dir, "benchmark").select(
        F.lpad(i.cast("string"), 5, "0").alias("entry_id"),
        "item_id",
        F.trim(F.regexp_extract("text", "^[^.!?\n]*", 0)).alias("short_title"),
        F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")).alias("main_author"),
        (1600 + i * 7 % 400).cast("int").alias("query_year"),
    )
    return with_once(out, "norm", normalize_text(F.col("short_title")))


#: Providers in priority order; others are unlisted.
HIERARCHY = ["src3", "src1", "src7", "src0"]
PROVIDERS = "providers AS (SELECT * FROM (VALUES ('src3', 0), ('src1', 1), ('src7', 2), ('src0', 3)) t(provider_key, priority))"


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i) for i, p in enumerate(HIERARCHY)], "provider_key string, priority int")


def shingles(words: Column) -> Column:
    """Distinct runs of three words; a shorter text is its own run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.when(n >= 3, F.array_distinct(runs)).otherwise(F.array(F.array_join(words, " ")))


SENTENCES = f"""
sentences AS (
  SELECT doc_id, source, lang, pos - 1 AS pos, title, {norm_sql("title")} AS norm FROM (
    SELECT doc_id, source, lang, generate_subscripts(a, 1) AS pos, trim(unnest(a), ' ') AS title
    FROM (SELECT doc_id, source, lang, string_split_regex(text, '[.!?\n]+') AS a FROM documents))
  WHERE title <> ''
)"""
RUNS = "list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END)"
HITS = f"""
work_runs AS (SELECT entry_id, unnest({RUNS}) AS run FROM (SELECT entry_id, string_split(norm, ' ') AS w FROM works WHERE norm <> '')),
sentence_runs AS (SELECT doc_id, pos, unnest({RUNS}) AS run FROM (SELECT doc_id, pos, string_split(norm, ' ') AS w FROM sentences WHERE norm <> '')),
found AS (SELECT entry_id, doc_id, pos, count(*) AS shared FROM work_runs JOIN sentence_runs USING (run) GROUP BY ALL),
placed AS (
  SELECT f.entry_id, s.source AS provider_key, s.doc_id, s.pos, s.title, s.lang, s.norm,
    row_number() OVER (PARTITION BY f.entry_id, s.source ORDER BY f.shared DESC, s.doc_id, s.pos) - 1 AS hit_ix
  FROM found f JOIN sentences s USING (doc_id, pos)
),
hits AS (
  SELECT entry_id, provider_key, CAST(substr(provider_key, 4) AS INTEGER) AS provider_ix, CAST(hit_ix AS INTEGER) AS hit_ix, title, norm AS title_norm, lang,
    doc_id || ':' || pos AS source_id,
    CASE doc_id % 3 WHEN 0 THEN 'https://iiif.example.org/' || doc_id || '/manifest' WHEN 1 THEN '' END AS iiif_manifest,
    CASE doc_id % 2 WHEN 0 THEN 'https://example.org/' || doc_id END AS item_url,
    CASE doc_id % 4 WHEN 1 THEN CAST(1600 + doc_id % 400 AS VARCHAR) WHEN 2 THEN '[' || (1600 + doc_id % 400) || '-1999]' WHEN 3 THEN 'S. XVIII' END AS date
  FROM placed WHERE hit_ix < 5
)"""


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where their files give fewer tasks; a large input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Hits of each work and provider in the SQL twin.
TWIN_HITS = 5


#: Wanted runs that are broadcast; about 40 bytes each.
BROADCAST_RUNS = 500_000


def found_sentences(sentences: DataFrame, asked: DataFrame, most: int = BROADCAST_RUNS) -> DataFrame:
    """(entry_id, doc_id, pos, source, lang, title, norm, shared): the sentences that share runs of words with a work.

    ``sentences``: doc_id, pos, source, lang, title, not yet normalised; ``asked``:
    entry_id, run.  Up to ``most`` wanted runs, which are counted, are broadcast, so nothing
    but hits is shuffled.  Beyond, runs meet by two hashes beside the sentence's place
    alone, and a sentence's text joins its hits afterwards, once.
    """
    keys = ["doc_id", "pos"]
    normed = with_once(sentences, "norm", normalize_text(F.col("title"))).filter("norm <> ''")
    words = with_once(normed, "words", F.split("norm", " "))
    if asked.count() <= most:
        offered = words.select(*keys, "source", "lang", "title", "norm", F.explode(shingles(F.col("words"))).alias("run"))
        carried = ("source", "lang", "title", "norm")
        return offered.join(F.broadcast(asked), "run").groupBy("entry_id", *keys).agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in carried])

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumns({"h1": F.xxhash64("run"), "h2": F.hash("run")}).drop("run")

    offered = hashed(words.select(*keys, F.explode(shingles(F.col("words"))).alias("run")))
    shared = offered.join(hashed(asked), ["h1", "h2"]).groupBy("entry_id", *keys).agg(F.count(F.lit(1)).alias("shared"))
    return with_once(shared.join(sentences, keys), "norm", normalize_text(F.col("title")))


def hits(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None, most: int | None = TWIN_HITS, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """The hits of the wanted works: the ``most`` first of each work and provider, or all."""
    wanted = works(spark, sf_dir) if wanted is None else wanted
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.posexplode(F.split("text", "[.!?\n]+")).alias("pos", "title"))
    sentences = docs.withColumn("title", F.trim("title")).filter("title <> ''")
    asked = with_once(wanted.filter("norm <> ''"), "words", F.split("norm", " ")).select("entry_id", F.explode(shingles(F.col("words"))).alias("run"))
    found = found_sentences(sentences, asked, broadcast_runs)
    w = Window.partitionBy("entry_id", "source").orderBy(F.col("shared").desc(), "doc_id", "pos")
    kept = found.withColumn("hit_ix", (F.row_number().over(w) - 1).cast("int"))
    if most is not None:
        kept = kept.filter(F.col("hit_ix") < most)
    d = F.col("doc_id")
    year = (1600 + d % 400).cast("string")
    return kept.select(
        "entry_id",
        F.col("source").alias("provider_key"),
        F.substring("source", 4, 9).cast("int").alias("provider_ix"),
        "hit_ix",
        "title",
        F.col("norm").alias("title_norm"),
        "lang",
        F.concat_ws(":", d, "pos").alias("source_id"),
        F.when(d % 3 == 0, F.concat(F.lit("https://iiif.example.org/"), d, F.lit("/manifest"))).when(d % 3 == 1, "").alias("iiif_manifest"),
        F.when(d % 2 == 0, F.concat(F.lit("https://example.org/"), d)).alias("item_url"),
        F.when(d % 4 == 1, year).when(d % 4 == 2, F.concat(F.lit("["), year, F.lit("-1999]"))).when(d % 4 == 3, "S. XVIII").alias("date"),
    )

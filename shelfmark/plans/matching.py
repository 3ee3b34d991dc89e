"""Queries over matching: normal forms, scores, gates, rankings, the search itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Selection, resolve_settings, resolved_threshold
from ..functions import dates, text
from ..functions.similarity import creator_score, with_title_score, with_token_bounds
from ..operators import select as sel
from ..session import kept
from .registry import query
from .views import BLANK, HIERARCHY, HITS, PROVIDERS, SENTENCES, TWIN_HITS, WORKS, hits, norm_sql, providers, table, tokens_sql, works

TITLES = f"titles AS (SELECT doc_id, trim(regexp_extract(text, '^[^.!?\n]*', 0), ' ') AS title, lang, source, text FROM documents)"
NORM = norm_sql("title")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_extract("text", "^[^.!?\n]*", 0)).alias("title"), "lang", "source", "text")


def sql_escape(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"SELECT doc_id, {NORM} AS normal FROM titles", TITLES)
def normalize_title(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", text.normalize_text(F.col("title")).alias("normal"))


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens_sql(NORM)} AS t FROM titles)", TITLES)
def tokens(spark, sf_dir):
    t = text.tokens(text.normalize_text(F.col("title")))
    return titles(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


SLUG = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, '[^0-9A-Za-z]+', '_', 'g'), '([A-Za-z])([0-9])', '\1_\2', 'g'), '([0-9])([A-Za-z])', '\1_\2', 'g'), '_+', '_', 'g'), '_')"""


def slug_sql(x: str) -> str:
    folded = f"lower(strip_accents({x}))"
    for a, b in text.LETTERS.items():
        folded = f"replace({folded}, '{a}', '{b}')"
    return SLUG.format(folded)


@query(f"SELECT doc_id, {slug_sql('''title || ' ' || source || 'x' || doc_id''')} AS slug FROM titles", TITLES)
def slug(spark, sf_dir):
    name = F.concat(F.col("title"), F.lit(" "), F.col("source"), F.lit("x"), F.col("doc_id"))
    return titles(spark, sf_dir).select("doc_id", text.snake_case(name).alias("slug"))


@query(f"SELECT entry_id, substr(sha1(norm || '|' || {norm_sql('main_author')}), 1, 10) AS work_id FROM works", WORKS)
def work_id(spark, sf_dir):
    return works(spark, sf_dir).select("entry_id", text.work_id(F.col("short_title"), F.col("main_author")).alias("work_id"))


@query(
    f"""SELECT entry_id, CASE WHEN short_title = '' THEN {slug_sql('entry_id')} || '_untitled'
      ELSE {slug_sql('entry_id')} || '_' || substr({slug_sql('short_title')}, 1, 80) END || '_' || query_year AS work_dir FROM works""",
    WORKS,
)
def work_dir(spark, sf_dir):
    return works(spark, sf_dir).select("entry_id", text.work_directory(F.col("entry_id"), F.col("short_title"), None, F.col("query_year")).alias("work_dir"))


@query(
    r"""SELECT page_id, CASE WHEN name = '' THEN '_untitled_' WHEN lower(base) IN ('con', 'prn', 'aux', 'nul') THEN '_' || base || '_' || ext ELSE base || ext END AS filename FROM (
      SELECT page_id, name, ext, CASE WHEN b = '' THEN '_untitled_' ELSE substr(b, 1, 100) END AS base FROM (
        SELECT page_id, name, trim(regexp_replace(regexp_replace(CASE WHEN stem = '' THEN last ELSE stem END, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '[\s._-]+', '_', 'g'), '._-') AS b,
          CASE WHEN stem = '' THEN '' ELSE suffix END AS ext FROM (
          SELECT page_id, name, last, regexp_extract(last, '^(?s)(.*?)((?:\.[A-Za-z0-9]{1,8}){0,2})$', 1) AS stem, regexp_extract(last, '^(?s)(.*?)((?:\.[A-Za-z0-9]{1,8}){0,2})$', 2) AS suffix
          FROM (SELECT page_id, url AS name, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS last FROM pages))))"""
)
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("filename"))


CREATORS = "people AS (SELECT doc_id, replace(text, '.', ';') AS cell, replace(trim(regexp_extract(text, '^[^.!?\n]*', 0), ' '), ' ', ', ') AS listing FROM documents)"


def people(spark, sf_dir):
    title = F.trim(F.regexp_extract("text", "^[^.!?\n]*", 0))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(";")).alias("cell"), F.replace(title, F.lit(" "), F.lit(", ")).alias("listing"))


@query(f"SELECT doc_id, len(c) AS n, array_to_string(c, '|') AS creators FROM (SELECT doc_id, list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x, {BLANK})), lambda x: x <> '') AS c FROM people)", CREATORS)
def creator_split(spark, sf_dir):
    c = text.split_creators(F.col("cell"))
    return people(spark, sf_dir).select("doc_id", F.size(c).cast("long").alias("n"), F.array_join(c, "|").alias("creators"))


@query(
    f"""SELECT doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS creators FROM people p LEFT JOIN (
      SELECT doc_id AS d, v, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM (
        SELECT doc_id, trim(v, {BLANK}) AS v, i, {norm_sql("v")} AS k FROM (
          SELECT doc_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split_regex(listing, '[,;/|]+') AS a FROM people)))
      WHERE v <> '' AND k <> '') x ON d = doc_id AND n = 1 GROUP BY doc_id""",
    CREATORS,
)
def creator_dedupe(spark, sf_dir):
    return people(spark, sf_dir).select("doc_id", F.array_join(text.split_creator_cell(F.col("listing")), "|").alias("creators"))


# titles as listings give them, with years, parentheses and separators after them
SCRAPED = "scraped AS (SELECT doc_id, title || CASE doc_id % 4 WHEN 0 THEN ' 1999 and  2001 more' WHEN 1 THEN ' (first) (second)' WHEN 2 THEN ' - /' ELSE '' END AS t FROM titles)"
CLEAN = r"""
c0 AS (SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS s FROM scraped),
c1 AS (SELECT doc_id, CASE WHEN length(h) > 20 THEN trim(h, ' ') ELSE s END AS s FROM (SELECT *, regexp_extract(s, '^(.*?\b(?:19|20)\d{2}\b.*?)\b(?:19|20)\d{2}\b', 1) AS h FROM c0)),
c2 AS (SELECT doc_id, CASE WHEN length(s) - length(replace(s, '(', '')) > 1 AND s LIKE '%)' AND p > 20 AND length(trim(left(s, p), ' ')) > 15 THEN trim(left(s, p), ' ') ELSE s END AS s
  FROM (SELECT *, length(s) - length(regexp_extract(s, '([^(]*)$', 1)) - 1 AS p FROM c1)),
c3 AS (SELECT doc_id, rtrim(s, ' -:;|/') AS s FROM c2),
c4 AS (SELECT doc_id, s, trim(left(s, 100), ' ') AS h FROM c3),
c5 AS (SELECT *, length(h) - length(regexp_extract(h, '([^ ]*)$', 1)) - 1 AS p FROM c4)"""


@query("SELECT doc_id, CASE WHEN length(s) <= 100 THEN s WHEN p > 40 THEN trim(left(h, p), ' ') ELSE h END AS title FROM c5", TITLES, SCRAPED, CLEAN)
def clean_titles(spark, sf_dir):
    d = F.col("doc_id")
    tail = F.when(d % 4 == 0, " 1999 and  2001 more").when(d % 4 == 1, " (first) (second)").when(d % 4 == 2, " - /").otherwise("")
    return titles(spark, sf_dir).select("doc_id", text.clean_title(F.concat("title", tail)).alias("title"))


@query()
def best_titles(spark, sf_dir):
    """Of the sentences found for each work and document source, the one that fits the wanted title best."""
    pairs = token_pairs(spark, sf_dir, most=None)
    return sel.best_titles(pairs, "entry_id", "short_title", "title", ["provider_ix", "hit_ix", "source_id"])


TOKEN_PAIRS = f"""
pairs AS (
  SELECT h.entry_id, h.source_id, {tokens_sql("w.norm")} AS a, {tokens_sql("h.title_norm")} AS b FROM hits h JOIN works w USING (entry_id)
),
parts AS (
  SELECT entry_id, source_id, a, b, list_sort(list_intersect(a, b)) AS s FROM pairs
),
joined AS (
  SELECT entry_id, source_id, a, b, len(s) AS shared, length(array_to_string(s, ' ')) AS n0,
    length(array_to_string(list_concat(s, list_filter(a, lambda x: NOT list_contains(b, x))), ' ')) AS n1,
    length(array_to_string(list_concat(s, list_filter(b, lambda x: NOT list_contains(a, x))), ' ')) AS n2 FROM parts
),
bounds AS (
  SELECT entry_id, source_id, shared, len(a) AS n_query, len(b) AS n_title,
    CASE WHEN len(a) = 0 OR len(b) = 0 OR n0 = 0 THEN 0 ELSE CAST(round_even(2.0 * greatest(CAST(n0 AS DOUBLE) / (n0 + n1), CAST(n0 AS DOUBLE) / (n0 + n2)) * 100, 0) AS INTEGER) END AS low,
    CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE CAST(round_even(2.0 * least(n1, n2) / CAST(n1 + n2 AS DOUBLE) * 100, 0) AS INTEGER) END AS high
  FROM joined
)"""


def token_pairs(spark, sf_dir, most=TWIN_HITS):
    w = works(spark, sf_dir)
    wanted = w.select("entry_id", text.tokens(F.col("norm")).alias("a"), "query_year", "main_author", "short_title")
    # the works of a search are its small side; Spark broadcasts them by their size
    return hits(spark, sf_dir, w, most).join(wanted, "entry_id").withColumn("b", text.tokens(F.col("title_norm")))


@query("SELECT entry_id, source_id, shared, n_query, n_title FROM bounds", WORKS, SENTENCES, HITS, TOKEN_PAIRS)
def token_overlap(spark, sf_dir):
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return token_pairs(spark, sf_dir).select("entry_id", "source_id", shared.alias("shared"), F.size("a").cast("long").alias("n_query"), F.size("b").cast("long").alias("n_title"))


@query("SELECT entry_id, source_id, low, high FROM bounds", WORKS, SENTENCES, HITS, TOKEN_PAIRS)
def token_set_bounds(spark, sf_dir):
    return with_token_bounds(token_pairs(spark, sf_dir), "a", "b", "").select("entry_id", "source_id", "low", "high")


@query("SELECT entry_id, source_id FROM bounds WHERE shared = least(n_query, n_title) AND shared > 0", WORKS, SENTENCES, HITS, TOKEN_PAIRS)
def subset_match(spark, sf_dir):
    shared = F.size(F.array_intersect("a", "b"))
    return token_pairs(spark, sf_dir).filter((shared > 0) & (shared == F.least(F.size("a"), F.size("b")))).select("entry_id", "source_id")


@query()
def token_set_ratio(spark, sf_dir):
    return with_title_score(token_pairs(spark, sf_dir, most=None), "short_title", "title", "score").select("entry_id", "source_id", "score")


@query()
def simple_ratio(spark, sf_dir):
    return with_title_score(token_pairs(spark, sf_dir, most=None), "short_title", "title", "score", "simple").select("entry_id", "source_id", "score")


@query()
def best_creator_score(spark, sf_dir):
    pairs = token_pairs(spark, sf_dir, most=None)
    return pairs.select("entry_id", "source_id", creator_score(F.col("main_author"), F.array("lang", "title")).alias("score"))


YEAR = "CAST(list_filter(list_transform(regexp_extract_all({0}, '\\b([0-9]{{4}})\\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1000 AND 2100)[1] AS INTEGER)"


@query(f"SELECT page_id, {YEAR.format('url')} AS year FROM pages")
def extract_year(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", dates.extract_year(F.col("url")).alias("year"))


PENALTY = "coalesce(least(25.0, 0.5 * greatest(0, abs({0} - query_year) - 15)), 0.0)"


@query(f"SELECT entry_id, source_id, {YEAR.format('date')} AS year, CAST({PENALTY.format(YEAR.format('date'))} AS DOUBLE) AS penalty FROM hits JOIN works USING (entry_id)", WORKS, SENTENCES, HITS)
def year_penalty(spark, sf_dir):
    year = dates.extract_year(F.col("date"))
    return token_pairs(spark, sf_dir).select("entry_id", "source_id", year.alias("year"), dates.year_penalty(year, F.col("query_year"), 15).alias("penalty"))


SCORED = f"""
scored AS (
  SELECT h.*, b.low AS title_score, w.query_year, CAST(b.low + CASE WHEN coalesce(iiif_manifest, '') <> '' THEN 3.0 ELSE 0 END + CASE WHEN coalesce(item_url, '') <> '' THEN 0.5 ELSE 0 END
    - {PENALTY.format(YEAR.format("date"))} AS DOUBLE) AS total, coalesce(priority, 9999) AS priority
  FROM hits h JOIN bounds b USING (entry_id, source_id) JOIN works w USING (entry_id) LEFT JOIN providers USING (provider_key)
)"""
ALL = (WORKS, SENTENCES, HITS, TOKEN_PAIRS, PROVIDERS, SCORED)
GATE = 40


def lower_bound_scores(spark, sf_dir):
    """Hits with the closed-form part of the title score, which SQL can state too."""
    pairs = with_token_bounds(token_pairs(spark, sf_dir), "a", "b", "ts_").withColumn("title_score", F.col("ts_low"))
    penalty = dates.year_penalty(dates.extract_year(F.col("date")), F.col("query_year"), 15)
    total = sel.total_score(F.col("title_score"), F.lit(0), 0.2, sel.boost(F.col("iiif_manifest"), F.col("item_url")), penalty)
    return sel.with_priority(pairs.withColumn("total", total), providers(spark))


def gate():
    return F.col("title_score") >= GATE


@query("SELECT entry_id, source_id, title_score, total FROM scored", *ALL)
def composite_score(spark, sf_dir):
    return lower_bound_scores(spark, sf_dir).select("entry_id", "source_id", "title_score", "total")


@query("SELECT entry_id, source_id, CAST(priority AS INTEGER) AS priority FROM scored", *ALL)
def provider_priority(spark, sf_dir):
    return lower_bound_scores(spark, sf_dir).select("entry_id", "source_id", "priority")


@query("SELECT entry_id, provider_key, source_id, total FROM scored WHERE title_score >= 40 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY priority, total DESC, provider_ix, hit_ix) = 1", *ALL)
def select_best(spark, sf_dir):
    return sel.select_best(lower_bound_scores(spark, sf_dir), "entry_id", gate()).select("entry_id", "provider_key", "source_id", "total")


@query(
    """SELECT entry_id, source_id, provider_ix, coalesce(mine AND n = 1, FALSE) AS selected FROM (
      SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY CASE WHEN mine THEN 0 ELSE 1 END, total DESC, hit_ix) AS n FROM (
        SELECT *, title_score >= 40 AND provider_ix = stop AS mine FROM (
          SELECT *, min(CASE WHEN title_score >= 40 THEN provider_ix END) OVER (PARTITION BY entry_id) AS stop FROM scored)
        WHERE stop IS NULL OR provider_ix <= stop))""",
    *ALL,
)
def first_hit(spark, sf_dir):
    return sel.first_hit(lower_bound_scores(spark, sf_dir), "entry_id", gate()).select("entry_id", "source_id", "provider_ix", "selected")


@query(
    """SELECT entry_id, source_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY priority, total DESC, provider_ix, hit_ix) AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY priority, total DESC, provider_ix, hit_ix) AS n FROM scored WHERE title_score >= 40)
    WHERE n > 1 AND provider_key IN (SELECT provider_key FROM providers)""",
    *ALL,
)
def ranked_fallbacks(spark, sf_dir):
    # the scores are read twice
    scored = kept(lower_bound_scores(spark, sf_dir), "scores")
    best = sel.select_best(scored, "entry_id", gate())
    return sel.fallbacks(scored, best, "entry_id", gate(), providers(spark)).select("entry_id", "source_id", "rank")


@query("SELECT entry_id, source_id FROM hits WHERE hit_ix < CASE WHEN provider_ix % 2 = 0 THEN 2 ELSE 3 END", WORKS, SENTENCES, HITS)
def candidate_cap(spark, sf_dir):
    limited = hits(spark, sf_dir).withColumn("most", F.when(F.col("provider_ix") % 2 == 0, 2).otherwise(3))
    return sel.cap_hits(limited, "entry_id", "most").select("entry_id", "source_id")


@query(
    """SELECT entry_id, source_id, CAST(place AS INTEGER) AS place, greatest(0, n - 10) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY title_score DESC, provider_ix, hit_ix) AS place, count(*) OVER (PARTITION BY entry_id) AS n FROM scored) WHERE place <= 10""",
    *ALL,
)
def top10_display(spark, sf_dir):
    return sel.display_top(kept(lower_bound_scores(spark, sf_dir), "scores"), "entry_id").select("entry_id", "source_id", "place", F.col("more").cast("long"))


@query(
    """SELECT w.entry_id, CASE WHEN s.provider_key IS NOT NULL THEN 'match' WHEN c.n IS NULL THEN 'no_candidates' ELSE 'no_match' END AS status,
      coalesce(c.n, 0) AS n_candidates, s.provider_key AS selected_provider, s.source_id AS selected_source_id, s.total AS selected_total
    FROM works w LEFT JOIN (SELECT entry_id, count(*) AS n FROM scored GROUP BY 1) c USING (entry_id)
    LEFT JOIN (SELECT * FROM scored WHERE title_score >= 40 QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY priority, total DESC, provider_ix, hit_ix) = 1) s USING (entry_id)""",
    *ALL,
)
def search_work_lb(spark, sf_dir):
    scored = lower_bound_scores(spark, sf_dir)
    found = sel.search_result(works(spark, sf_dir), scored, gate(), "entry_id")
    return found.select("entry_id", "status", "n_candidates", "selected_provider", "selected_source_id", "selected_total")


def search(spark: SparkSession, wanted: DataFrame, found: DataFrame, settings: Selection, dim: DataFrame) -> DataFrame:
    """The search result of wanted works over captured hits: score, gate, rank, select."""
    asked = wanted.select("entry_id", F.col("short_title").alias("query_title"), F.col("main_author").alias("query_creator"), "query_year")
    capped = sel.cap_hits(found, "entry_id", settings.max_candidates_per_provider)
    scored = sel.with_scores(capped.join(asked, "entry_id"), settings.creator_weight, settings.year_tolerance, settings.method)
    scored = sel.with_priority(scored, dim)
    return sel.search_result(wanted, scored, F.col("title_score") >= settings.min_title_score, "entry_id")


@query()
def search_work(spark, sf_dir):
    """The flagship: each wanted work with its status, its selected record and its candidates."""
    wanted = works(spark, sf_dir)
    found = hits(spark, sf_dir, wanted, most=None).withColumn("creators", F.array("lang"))
    out = search(spark, wanted, found, Selection(min_title_score=GATE, year_tolerance=15), providers(spark))
    return out.select("entry_id", "status", "n_candidates", "selected_provider", "selected_source_id", "selected_total", F.to_json("candidates").alias("candidates"))


@query("SELECT source AS provider_key, CAST(row_number() OVER (ORDER BY coalesce(priority, 9999), CAST(substr(source, 4) AS INTEGER)) - 1 AS INTEGER) AS priority FROM (SELECT DISTINCT source FROM documents) LEFT JOIN providers ON provider_key = source", PROVIDERS)
def ordered_providers(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("provider_key"), F.substring("source", 4, 9).cast("int").alias("ix"))
    return sel.provider_ranks(names, HIERARCHY, "ix")


SETTINGS = "settings AS (SELECT * FROM (VALUES ('gallica', '45', 3), ('src1', '60', 2), ('src2', 'high', NULL), ('bnf', '1', 1)) t(provider_key, min_title_score, max_results))"
ROWS = "setting_rows AS (SELECT doc_id, CASE source WHEN 'src0' THEN 'bnf_gallica' ELSE source END AS provider_key FROM documents)"


def setting_rows(spark, sf_dir):
    settings = spark.createDataFrame([("gallica", "45", 3), ("src1", "60", 2), ("src2", "high", None), ("bnf", "1", 1)], "provider_key string, min_title_score string, max_results int")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "bnf_gallica").otherwise(F.col("source")).alias("provider_key"))
    return resolve_settings(rows, settings, "provider_key", ["min_title_score", "max_results"])


JOINED = "FROM setting_rows r LEFT JOIN settings o USING (provider_key) LEFT JOIN settings a ON r.provider_key = 'bnf_gallica' AND a.provider_key = 'gallica'"


@query(f"SELECT r.doc_id, r.provider_key, CASE WHEN o.provider_key IS NOT NULL THEN o.max_results ELSE a.max_results END AS max_results {JOINED}", SETTINGS, ROWS)
def settings_alias(spark, sf_dir):
    return setting_rows(spark, sf_dir).select("doc_id", "provider_key", "max_results")


@query(f"SELECT r.doc_id, coalesce(try_cast(CASE WHEN o.provider_key IS NOT NULL THEN o.min_title_score ELSE a.min_title_score END AS DOUBLE), 35.0) AS threshold {JOINED}", SETTINGS, ROWS)
def threshold_resolve(spark, sf_dir):
    return setting_rows(spark, sf_dir).select("doc_id", resolved_threshold(F.col("min_title_score"), F.lit("35"), 85).alias("threshold"))




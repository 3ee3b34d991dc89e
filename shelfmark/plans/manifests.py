"""Queries over IIIF manifests.

Conversations become manifests: even ones in version 2, odd ones in version 3, one canvas
per turn, with services, direct images, choices, repeated pages and broken canvases.  The
SQL twins state the expected pages from the conversations themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import iiif
from .registry import query
from .views import table


def fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"<{k}>"), v.cast("string"))
    return out


TWO = {
    0: '{"images":[{"resource":{"@id":"https://img/<c>/<t>/x.jpg","service":{"@id":"https://iiif/<c>/<t>"}}}]}',
    1: '{"images":[{"resource":{"@id":"https://img/<c>/<t>/direct.jpg"}}]}',
    2: '{"images":[{"resource":{"@type":"oa:Choice","default":{"@id":"https://img/<c>/<t>/full/max/0/d.jpg"}}}]}',
}
THREE = {
    0: '{"items":[{"items":[{"body":{"id":"https://img/<c>/<t>/x.jpg","service":[{"type":"auth"},{"id":"https://iiif/<c>/<t>"}]}}]}]}',
    1: '{"items":[{"items":[{"body":[{"id":"https://img/<c>/<t>/direct.jpg"},{"id":"other"}]}]}]}',
    2: '{"items":[{"items":[{"body":{"type":"Choice","items":[{"id":"https://img/<c>/<t>/full/max/0/d.jpg"}]}}]}]}',
}
BROKEN = '{"images":[],"items":[]}'
HEAD_TWO = '{"label":"C<c>","attribution":"By <c>","metadata":[{"label":"turns","value":"x"},{"label":"turns","value":"<n>"},{"label":{"en":["k"]},"value":["v<c>"]}],"rendering":[{"@id":"https://r/<c>.epub","format":"application/epub+zip"},{"@id":"https://r/<c>.html","format":"text/html"}],"sequences":<s>}'
HEAD_THREE = '{"label":{"none":["C<c>"]},"requiredStatement":{"label":{"en":["by"]},"value":{"en":["By <c>"]}},"metadata":[{"label":{"en":["turns"]},"value":{"en":["<n>"]}},{"label":"","value":"dropped"},{"label":["k"],"value":"v<c>"}],"rendering":{"id":"https://r/<c>.epub","format":["application/epub+zip"]},"items":[<canvases>]}'
SEQUENCE = '{"rendering":{"@id":"https://r/<c>.pdf","type":"Text","label":"all"},"canvases":[<canvases>]}'


def manifests(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), "turn", F.length("text").alias("n"))
    place = F.col("turn") % 6
    canvas = None
    for r in range(3):
        shape = F.when(F.col("c") % 2 == 0, fill(TWO[r], c=F.col("c"), t=place)).otherwise(fill(THREE[r], c=F.col("c"), t=place))
        canvas = F.when(place % 3 == r, shape) if canvas is None else canvas.when(place % 3 == r, shape)
    canvas = F.when(F.col("n") % 7 == 0, BROKEN).otherwise(canvas)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", canvas.alias("v")))), lambda x: x["v"]), ",")
    m = t.groupBy("c").agg(listed.alias("canvases"), F.count(F.lit(1)).alias("n"))
    sequence = fill(SEQUENCE, c=F.col("c"), canvases=F.col("canvases"))
    sequences = F.when(F.col("c") % 4 == 0, sequence).otherwise(F.concat(F.lit("["), sequence, F.lit("]")))
    two = fill(HEAD_TWO, c=F.col("c"), n=F.col("n"), s=sequences)
    three = fill(HEAD_THREE, c=F.col("c"), n=F.col("n"), canvases=F.col("canvases"))
    body = F.when(F.col("c") % 10 == 9, "not json").when(F.col("c") % 2 == 0, two).otherwise(three)
    return m.select("c", body.alias("body"))


PAGES = """
canvases AS (SELECT conv_id AS c, turn, turn % 6 AS t, 'https://img/' || conv_id || '/' || (turn % 6) AS img, 'https://iiif/' || conv_id || '/' || (turn % 6) AS svc FROM conversations WHERE length(text) % 7 <> 0 AND conv_id % 10 <> 9),
sources AS (SELECT c, turn, CASE t % 3 WHEN 0 THEN svc WHEN 2 THEN img END AS service, CASE t % 3 WHEN 0 THEN img || '/x.jpg' WHEN 1 THEN img || '/direct.jpg' ELSE img || '/full/max/0/d.jpg' END AS image FROM canvases)"""


def first(column: str) -> str:
    return f"SELECT c, url, CAST(row_number() OVER (PARTITION BY c ORDER BY turn) AS INTEGER) AS ord FROM (SELECT c, {column} AS url, min(turn) AS turn FROM sources WHERE {column} IS NOT NULL GROUP BY 1, 2)"


@query(first("service"), PAGES)
def iiif_services(spark, sf_dir):
    return iiif.image_services(manifests(spark, sf_dir), "c", "body")


@query(first("image"), PAGES)
def iiif_direct(spark, sf_dir):
    return iiif.direct_images(manifests(spark, sf_dir), "c", "body")


@query(first("coalesce(service, image)").replace("SELECT c, url, CAST", "SELECT c, CASE WHEN url LIKE '%/direct.jpg' THEN 'direct' ELSE 'service' END AS kind, url, CAST"), PAGES)
def iiif_pages(spark, sf_dir):
    return iiif.page_sources(manifests(spark, sf_dir), "c", "body")


@query(
    """SELECT conv_id AS c, CASE WHEN conv_id % 10 <> 9 THEN 'C' || conv_id END AS label, CASE WHEN conv_id % 10 <> 9 THEN 'By ' || conv_id END AS attribution,
      CASE WHEN conv_id % 10 <> 9 THEN CAST(count(*) AS VARCHAR) END AS turns, CASE WHEN conv_id % 10 <> 9 THEN 'v' || conv_id END AS k FROM conversations GROUP BY conv_id"""
)
def iiif_metadata(spark, sf_dir):
    m = iiif.manifest_metadata(manifests(spark, sf_dir), "c", "body")
    return m.select("c", "label", "attribution", F.try_element_at("metadata", F.lit("turns")).alias("turns"), F.try_element_at("metadata", F.lit("k")).alias("k"))


@query(
    """SELECT c, url, rank, CAST(row_number() OVER (PARTITION BY c ORDER BY rank) AS INTEGER) AS ord FROM (
      SELECT DISTINCT conv_id AS c, 'https://r/' || conv_id || '.epub' AS url, 1 AS rank FROM conversations WHERE conv_id % 10 <> 9
      UNION ALL SELECT DISTINCT conv_id, 'https://r/' || conv_id || '.pdf', 0 FROM conversations WHERE conv_id % 2 = 0)"""
)
def renderings_ranked(spark, sf_dir):
    return iiif.renderings(manifests(spark, sf_dir), "c", "body").select("c", "url", "rank", "ord")


@query(f"SELECT c, ord FROM ({first('coalesce(service, image)')}) WHERE ord <= 2", PAGES)
def page_slice(spark, sf_dir):
    return iiif.first_pages(iiif.page_sources(manifests(spark, sf_dir), "c", "body"), 2).select("c", "ord")


@query(
    f"""SELECT c, count(*) AS pages_expected, count(*) FILTER (WHERE saved) AS pages_downloaded,
      CASE WHEN count(*) FILTER (WHERE saved) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE saved) < count(*) THEN 'partial' ELSE 'completed' END AS status
    FROM (SELECT c, c % 4 <> 3 AND (c + ord) % 5 <> 0 OR c % 4 = 1 AS saved FROM ({first('coalesce(service, image)')})) GROUP BY c""",
    PAGES,
)
def completeness(spark, sf_dir):
    c, o = F.col("c"), F.col("ord")
    pages = iiif.page_sources(manifests(spark, sf_dir), "c", "body").withColumn("saved", ((c % 4 != 3) & ((c + o) % 5 != 0)) | (c % 4 == 1))
    return iiif.completeness(pages, "c", "saved")


W = "CASE WHEN vec_id % 4 = 0 THEN 3000 WHEN vec_id % 4 = 1 THEN least(3000, 1200) WHEN vec_id % 4 = 2 THEN 0 ELSE 800 END"


@query(
    f"""SELECT vec_id, array_to_string(list_distinct_in_order, ' ') AS urls FROM (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_concat(list_transform(ladder, lambda u: regexp_replace(u, '\\.jpg$', '.png')), ladder) ELSE ladder END AS list_distinct_in_order FROM (
      SELECT vec_id, list_concat(CASE WHEN w > 0 THEN [b || '/full/' || w || ',/0/default.jpg', b || '/full/' || w || ',/0/native.jpg'] ELSE [] END,
        [b || '/full/full/0/default.jpg', b || '/full/max/0/default.jpg', b || '/full/pct:100/0/default.jpg', b || '/full/full/0/native.jpg', b || '/full/full/0/color.jpg'],
        CASE WHEN w > 0 THEN [] ELSE [b || '/full/2000,/0/default.jpg', b || '/full/1000,/0/default.jpg'] END) AS ladder
      FROM (SELECT vec_id, 'https://iiif/' || vec_id AS b, {W} AS w FROM embeddings)))"""
)
def image_candidates(spark, sf_dir):
    i = F.col("vec_id")
    formats = F.when(i % 5 == 0, ',"formats":["jpg","PNG"]').otherwise("")
    sizes = F.when(i % 4 == 0, '"sizes":[{"width":90},{"width":3000},{"height":1}]').when(i % 4 == 1, '"sizes":[{"width":3000}],"maxWidth":1200').when(i % 4 == 2, '"sizes":[]').otherwise('"maxWidth":800')
    info = F.try_parse_json(F.concat(F.lit("{"), sizes, formats, F.lit("}")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("https://iiif/"), i, F.lit("/")).alias("b"), info.alias("info"))
    return rows.select("vec_id", F.array_join(iiif.image_url_ladder(F.col("b"), F.col("info")), " ").alias("urls"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'p' || vec_id || '_i' || label WHEN vec_id % 3 = 1 THEN 'direct_iiif_i' || label ELSE 'p' || vec_id || '_unknown' END AS stem FROM embeddings")
def file_stem(spark, sf_dir):
    i = F.col("vec_id")
    provider = F.when(i % 3 != 1, F.concat(F.lit("p"), i)).otherwise("")
    item = F.when(i % 3 != 2, F.concat(F.lit("i"), F.col("label")))
    return table(spark, sf_dir, "embeddings").select("vec_id", iiif.file_stem("_{provider}_{item_id}_ ", F.lit(""), F.lit(None), provider, item).alias("stem"))

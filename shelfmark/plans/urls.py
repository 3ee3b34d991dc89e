"""Queries over URLs, identifiers and payload headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, payload
from ..functions.text import strip
from .registry import query
from .views import BLANK, table


def q(text: str) -> str:
    return text.replace("'", "''")


# links of many kinds, made from page numbers
LINKS = r"""
links AS (
  SELECT page_id, CASE page_id % 12
    WHEN 0 THEN 'https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb' || page_id || '/manifest'
    WHEN 1 THEN 'https://gallica.bnf.fr/iiif/ark:/12148/bpt6k' || page_id || '/manifest.json'
    WHEN 2 THEN 'https://archive.org/details/book' || page_id
    WHEN 3 THEN 'https://www.loc.gov/item/' || page_id || '/?api_key=' || page_id
    WHEN 4 THEN 'HTTPS://User@Tile.LOC.gov:443/x?sig='
    WHEN 5 THEN 'https://www.e-rara.ch/i3f/v20/' || page_id || '/manifest'
    WHEN 6 THEN 'ftp://polona.pl/item/' || page_id
    WHEN 7 THEN 'https://iiif.wellcomecollection.org/presentation/v3/b' || page_id || '?access_token=t'
    WHEN 8 THEN 'https://digi.ub.uni-heidelberg.de/diglit/h' || page_id
    WHEN 9 THEN 'no link ' || page_id
    WHEN 10 THEN 'https://notarchive.org.example.com/view/x' || page_id || '#token=1'
    ELSE url END AS link
  FROM pages)"""


def links(spark, sf_dir):
    i = F.col("page_id")
    made = {
        0: ("https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb", "/manifest"), 1: ("https://gallica.bnf.fr/iiif/ark:/12148/bpt6k", "/manifest.json"), 2: ("https://archive.org/details/book", ""),
        5: ("https://www.e-rara.ch/i3f/v20/", "/manifest"), 6: ("ftp://polona.pl/item/", ""), 7: ("https://iiif.wellcomecollection.org/presentation/v3/b", "?access_token=t"),
        8: ("https://digi.ub.uni-heidelberg.de/diglit/h", ""), 9: ("no link ", ""), 10: ("https://notarchive.org.example.com/view/x", "#token=1"),
    }
    link = F.when(i % 12 == 3, F.concat(F.lit("https://www.loc.gov/item/"), i, F.lit("/?api_key="), i)).when(i % 12 == 4, "HTTPS://User@Tile.LOC.gov:443/x?sig=")
    for k, (a, b) in made.items():
        link = link.when(i % 12 == k, F.concat(F.lit(a), i, F.lit(b)))
    return table(spark, sf_dir, "pages").select("page_id", link.otherwise(F.col("url")).alias("link"))


#: URLs of every kind and, written by hand, whether each is a manifest and whose it is; ``{0}`` is the page's number.
URL_KINDS = [
    ("https://x.example.org/a/{0}/manifest.json", True, "direct_iiif"), ("\thttps://x.example.org/b/{0}/manifest\n", True, "direct_iiif"), ("https://iiif.archive.org/iiif/b{0}/manifest/x", True, "internet_archive"),
    ("https://iiif.archivelab.org/iiif/b{0}/manifest?v=2", True, "internet_archive"), ("https://gallica.bnf.fr/iiif/ark:/12148/b{0}", True, "bnf_gallica"), ("https://api.digitale-sammlungen.de/iiif/presentation", True, "mdz"),
    ("https://www.digitale-sammlungen.de/x/{0}/manifest?", True, "mdz"), ("https://babel.hathitrust.org/cgi/imgsrv/manifest/mdp.{0}", True, "hathitrust"), ("https://www.LOC.gov/item/{0}/Manifest?x", True, "loc"),
    ("https://iiif.wellcomecollection.org/presentation/v2/b{0}", True, "wellcome"), ("https://api.bl.uk/metadata/iiif/ark:/81055/{0}", True, "british_library"), ("https://www.e-rara.ch/i3f/v21/{0}/manifest?", True, "e_rara"),
    ("https://digital.slub-dresden.de/data/{0}/manifest?", True, "slub"), ("https://content.staatsbibliothek-berlin.de/dc/{0}/manifest?", True, "sbb_digital"), ("https://x.example.org/iiif/{0}/manifest?", True, "direct_iiif"),
    ("https://x.example.org/presentation/v3/{0}/manifest?", True, "direct_iiif"), ("\xa0http://x.example.org/iiif/presentation/{0} ", True, "direct_iiif"), ("https://x.example.org/iiif/b{0}/manifest?", False, "direct_iiif"),
    ("ftp://x.example.org/{0}/manifest", False, "direct_iiif"), ("HTTPS://x.example.org/{0}/manifest", False, "direct_iiif"), ("https://www.europeana.eu/item/{0}", False, "europeana"), ("https://polona.pl/item/{0}", False, "polona"),
    ("https://api.ddb.de/{0}", False, "ddb"), ("https://www.deutsche-digitale-bibliothek.de/item/{0}", False, "ddb"), ("https://bdh.bne.es/{0}", False, "bne"), ("manifest {0}", False, "direct_iiif"), ("", False, "direct_iiif"),
]
#: Links of records and, written by hand, the manifests that they lead to.
RECORD_KINDS = [
    ("https://digi.ub.uni-heidelberg.de/diglit/h{0}?x=1", "https://digi.ub.uni-heidelberg.de/diglit/iiif/h{0}/manifest.json"), ("http://resolver.sub.uni-goettingen.de/purl?PPN{0}&a=1", "https://manifests.sub.uni-goettingen.de/iiif/presentation/PPN{0}/manifest"),
    ("http://mdz-nbn-resolving.de/urn:nbn:de:bvb:12-bsb{0}-5", "https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb{0}/manifest"), ("https://www.digitale-sammlungen.de/view/bsb{0}", "https://api.digitale-sammlungen.de/iiif/presentation/v2/bsb{0}/manifest"),
    ("https://www.digitale-sammlungen.de/view/ {0}", None), ("https://example.org/{0}", None),
]


def kind_sql(values: list, key: str = "page_id") -> str:
    """The value of a row's kind in SQL."""
    shown = ["NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"replace('{v}', '{{0}}', CAST({key} AS VARCHAR))" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


def of_kind(values: list[str], key):
    """The text of a row's kind."""
    return F.replace(F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int")), F.lit("{0}"), key.cast("string"))


@query(f"SELECT o_orderkey AS k, {kind_sql([m for _, m, _ in URL_KINDS], 'o_orderkey')} AS is_manifest FROM orders")
def is_manifest_url(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), ids.is_manifest_url(of_kind([u for u, _, _ in URL_KINDS], k)).alias("is_manifest"))


@query(f"SELECT o_orderkey AS k, {kind_sql([p for _, _, p in URL_KINDS], 'o_orderkey')} AS provider FROM orders")
def provider_from_url(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), ids.provider_of_url(of_kind([u for u, _, _ in URL_KINDS], k)).alias("provider"))


HOSTS = "hosts AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{p}', {i})" for i, (p, hs) in enumerate(ids.PROVIDER_HOSTS.items()) for h in hs) + ") t(host, provider_key, ord))"
HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"


@query(f"SELECT page_id, first(provider_key ORDER BY ord) AS provider_key FROM (SELECT page_id, {HOST} AS h FROM links) LEFT JOIN hosts ON h = host OR suffix(h, '.' || host) GROUP BY 1", LINKS, HOSTS)
def url_provider(spark, sf_dir):
    return ids.with_provider_of_host(links(spark, sf_dir), "link", "page_id").select("page_id", "provider_key")


REST = "regexp_replace(regexp_replace(regexp_replace(link, '^.*?://', ''), '(?i)/manifest\\.json$', ''), '(?i)/manifest$', '')"
PATTERNS = ", ".join(f"CASE WHEN regexp_matches(rest, '{p}') THEN regexp_extract(rest, '{p}', 1) END" for p in ids.ITEM_ID_PATTERNS)


@query(f"SELECT page_id, coalesce({PATTERNS}, substr(md5(link), 1, 12)) AS item_id FROM (SELECT page_id, link, {REST} AS rest FROM links)", LINKS)
def item_id(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", ids.item_id(F.col("link")).alias("item_id"))


# identifiers of many kinds, made from order numbers
KINDS = ["bsb{0}", "BPT6K{0}a", "btv1b{0}", "cb{0}x", "ark:/12148/bpt6k{0}", "mdp.{0}", "uc1.{0}", "wu.{0}", "vdc_{0}", "bsb{0}-1", "isbn:{0}-3", " bsb{0} ", "bsb{0}\n", "\tbsb{0} \xa0", "bpt6k{0}\r\n", "bsb{0} x"]
NAMES = "names AS (SELECT o_orderkey AS k, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN replace('{t}', '{{0}}', CAST(o_orderkey AS VARCHAR))" for i, t in enumerate(KINDS)) + " END AS name FROM orders)"
DETECT = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(trim(name, {BLANK}), '{p}') THEN '{k}' END" for p, k in ids.IDENTIFIER_PATTERNS) + "], lambda x: x IS NOT NULL))"


def names(spark, sf_dir):
    k = F.col("o_orderkey")
    name = None
    for i, t in enumerate(KINDS):
        v = F.replace(F.lit(t), F.lit("{0}"), k.cast("string"))
        name = F.when(k % len(KINDS) == i, v) if name is None else name.when(k % len(KINDS) == i, v)
    return table(spark, sf_dir, "orders").select(k.alias("k"), name.alias("name"))


@query(f"SELECT k, array_to_string({DETECT}, ',') AS providers FROM names", NAMES)
def detect_provider(spark, sf_dir):
    return names(spark, sf_dir).select("k", F.array_join(ids.providers_of_identifier(F.col("name")), ",").alias("providers"))


TEMPLATES = "templates AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{t}')" for p, i, t in ids.MANIFEST_TEMPLATES) + ") t(provider, ord, template))"


@query(
    f"""SELECT k, ord AS manifest_ord, replace(template, '{{id}}', CASE WHEN provider = 'bnf_gallica' THEN regexp_replace(name, '^ark:/12148/', '') ELSE name END) AS manifest_url
    FROM (SELECT k, trim(name, {BLANK}) AS name, unnest({DETECT}) AS provider FROM names) JOIN templates USING (provider)""",
    NAMES, TEMPLATES,
)
def manifest_urls(spark, sf_dir):
    found = names(spark, sf_dir).select("k", strip(F.col("name")).alias("name"), F.explode(ids.providers_of_identifier(F.col("name"))).alias("provider"))
    return ids.with_manifest_urls(found, "name", "provider").select("k", "manifest_ord", "manifest_url")


IDS_TEXT = "texts AS (SELECT o_orderkey AS k, 'OCLC: ' || o_orderkey || ' isbn:978-0-' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' htid:mdp.' || o_orderkey || ', issn 1234' ELSE ' ISSN:1234-567X lccn: a/' || o_custkey END || CASE WHEN o_orderkey % 5 = 0 THEN ' oclc:7' ELSE '' END AS t FROM orders)"
NO_HYPHEN = "replace(x, '-', '')"
PARTS = " || ".join(
    f"CASE WHEN len({v}) > 0 THEN '{k}=' || array_to_string({v}, '+') || ';' ELSE '' END"
    for k, v in ((k, f"list_transform(regexp_extract_all(t, '(?i){k}\\s*:\\s*{p}', 1), lambda x: {NO_HYPHEN if k == 'isbn' else 'x'})") for k, p in ids.EXPLICIT_IDS)
)


@query(f"SELECT k, {PARTS} AS found FROM texts", IDS_TEXT)
def explicit_ids(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = F.concat(F.lit("OCLC: "), k, F.lit(" isbn:978-0-"), c, F.when(k % 3 == 0, F.concat(F.lit(" htid:mdp."), k, F.lit(", issn 1234"))).otherwise(F.concat(F.lit(" ISSN:1234-567X lccn: a/"), c)), F.when(k % 5 == 0, " oclc:7").otherwise(""))
    found = F.map_entries(ids.explicit_ids(F.col("t")))
    joined = F.array_join(F.transform(found, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"), F.lit(";"))), "")
    return table(spark, sf_dir, "orders").select(k.alias("k"), t.alias("t")).select("k", joined.alias("found"))


CREDENTIAL = "(list_contains([" + ", ".join(f"'{n}'" for n in ids.CREDENTIAL_NAMES) + f"], n) OR regexp_matches(n, '{ids.CREDENTIAL_ENDS}'))"


@query(
    f"""SELECT page_id, coalesce(bool_or({CREDENTIAL}), FALSE) AS secret FROM links LEFT JOIN (
      SELECT page_id AS p, regexp_replace(lower(split_part(x, '=', 1)), '[^a-z0-9]', '', 'g') AS n FROM (SELECT page_id, unnest(string_split(regexp_extract(link, '\\?([^#]*)', 1), '&')) AS x FROM links) WHERE regexp_matches(x, '=.')) ON p = page_id GROUP BY 1""",
    LINKS,
)
def credential_params(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", ids.carries_credential(F.col("link")).alias("secret"))


@query(f"SELECT o_orderkey AS k, {kind_sql([m for _, m in RECORD_KINDS], 'o_orderkey')} AS manifest FROM orders")
def record_link_manifest(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), ids.manifest_of_record_link(of_kind([u for u, _ in RECORD_KINDS], k)).alias("manifest"))


TYPES = ["application/pdf", "Application/EPUB+zip; charset=x", "image/JPEG", "application/octet-stream", "text/html; charset=utf-8", "x/unknown", "binary/octet-stream ;a", "application/xml", "image/jp2", ""]
HEADERS = "headers AS (SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END AS ct, CASE event_id % 4 WHEN 0 THEN 'https://a.org/book.PDF?x=1' WHEN 1 THEN 'https://a.org/x?output=epub' WHEN 2 THEN 'https://a.org/view' ELSE 'https://annas-archive.org/md5/1' END AS url, CAST(160000 + event_id % 300 * 100 AS BIGINT) AS length FROM events)"


def headers(spark, sf_dir):
    i = F.col("event_id")
    kind = None
    for k, t in enumerate(TYPES):
        kind = F.when(i % 10 == k, t) if kind is None else kind.when(i % 10 == k, t)
    url = F.when(i % 4 == 0, "https://a.org/book.PDF?x=1").when(i % 4 == 1, "https://a.org/x?output=epub").when(i % 4 == 2, "https://a.org/view").otherwise("https://annas-archive.org/md5/1")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("ct"), url.alias("url"), (160_000 + i % 300 * 100).alias("length"))


EXT = "CASE WHEN trim(split_part(lower(ct), ';', 1), ' ') IN (" + ", ".join(f"'{g}'" for g in payload.GENERIC_TYPES) + ") THEN '' " + " ".join(f"WHEN contains(lower(ct), '{f}') THEN '{e}'" for f, e in payload.TYPE_EXTENSIONS) + " ELSE '' END"


@query(f"SELECT event_id, {EXT} AS ext FROM headers", HEADERS)
def ext_from_mime(spark, sf_dir):
    return headers(spark, sf_dir).select("event_id", payload.extension_of_type(F.col("ct")).alias("ext"))


@query(f"SELECT event_id, CASE WHEN ext IN ('.pdf', '.epub', '.zip') THEN 'pdfs' WHEN ext IN ('.json', '.xml', '.html', '.txt') THEN 'metadata' ELSE 'images' END AS bucket FROM (SELECT event_id, {EXT} AS ext FROM headers)", HEADERS)
def budget_bucket(spark, sf_dir):
    return headers(spark, sf_dir).select("event_id", payload.budget_bucket(payload.extension_of_type(F.col("ct"))).alias("bucket"))


@query(f"SELECT event_id, CASE WHEN ext IN ('.pdf', '.jpg') THEN 'objects' ELSE 'metadata' END AS folder FROM (SELECT event_id, {EXT} AS ext FROM headers)", HEADERS)
def route_dir(spark, sf_dir):
    return headers(spark, sf_dir).select("event_id", payload.target_folder(payload.extension_of_type(F.col("ct")), [".pdf", ".jpg"]).alias("folder"))


@query("SELECT event_id, contains(lower(ct), 'text/html') AND (contains(lower(url), '.pdf?') OR contains(lower(url), 'output=epub') OR (contains(url, 'annas-archive') AND length > 170000 AND length < 185000)) AS rejected FROM headers", HEADERS)
def html_reject(spark, sf_dir):
    return headers(spark, sf_dir).select("event_id", payload.rejects_html(F.col("ct"), F.col("url"), F.col("length")).alias("rejected"))


HEADS = ["255044462D312E34", "89504E470D0A1A0A00", "FFD8FFE0", "0000000C6A5020200D0A870A", "FF4FFF5100", "49492A0000", "504B0304" + b"mimetypeapplication/epub+zip".hex().upper(), "504B030414", "3C68746D6C", ""]
WANT = [".pdf", ".png", ".jpg", ".jp2", ".jp2", ".tif", ".epub", ".zip", "", ""]


@query("SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(WANT)) + " END AS ext FROM events")
def magic_sniff(spark, sf_dir):
    i = F.col("event_id")
    head = None
    for k, h in enumerate(HEADS):
        head = F.when(i % 10 == k, F.lit(h)) if head is None else head.when(i % 10 == k, F.lit(h))
    return table(spark, sf_dir, "events").select("event_id", F.unhex(head).alias("head")).select("event_id", payload.sniff_extension(F.col("head")).alias("ext"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 4 THEN 7 END AS length FROM events")
def content_length(spark, sf_dir):
    i = F.col("event_id")
    header = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, "-4").when(i % 5 == 2, "x1").when(i % 5 == 4, " 7 ")
    return table(spark, sf_dir, "events").select("event_id", payload.content_length(header).alias("length"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id || '.pdf' WHEN 1 THEN 'é b' || event_id || '.pdf' WHEN 2 THEN 'x.pdf' ELSE 'late.pdf' END AS filename FROM events")
def disposition_filename(spark, sf_dir):
    i = F.col("event_id")
    header = (
        F.when(i % 4 == 0, F.concat(F.lit('attachment; filename="a'), i, F.lit('.pdf"')))
        .when(i % 4 == 1, F.concat(F.lit("attachment; filename=y.pdf; filename*=UTF-8''%C3%A9%20b"), i, F.lit(".pdf")))
        .when(i % 4 == 2, "inline;FileName = x.pdf")
        .otherwise("inline" + "".join(f"; p{n}={n}" for n in range(1200)) + ";\tfilename=late.pdf\n")
    )
    return table(spark, sf_dir, "events").select("event_id", header.alias("h")).select("event_id", payload.disposition_filename(F.col("h")).alias("filename"))

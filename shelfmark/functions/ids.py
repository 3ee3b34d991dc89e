"""URLs and identifiers: manifest tests, providers by host or pattern, item ids, manifest URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import strip

# What a manifest URL looks like (case ignored).
MANIFEST_PATTERNS = [
    r"manifest\.json$",
    r"/manifest$",
    r"iiif\.archive\.org/iiif/.+/manifest",
    r"iiif\.archivelab\.org/iiif/.+/manifest",
    r"gallica\.bnf\.fr/iiif/ark:",
    r"api\.digitale-sammlungen\.de/iiif/presentation",
    r"digitale-sammlungen\.de/.+/manifest",
    r"babel\.hathitrust\.org/cgi/imgsrv/manifest",
    r"loc\.gov/.+/manifest",
    r"iiif\.wellcomecollection\.org/presentation",
    r"api\.bl\.uk/metadata/iiif",
    r"e-rara\.ch/i3f/v\d+/.+/manifest",
    r"digital\.slub-dresden\.de/.+/manifest",
    r"content\.staatsbibliothek-berlin\.de/.+/manifest",
    r"/iiif/\d+/manifest",
    r"/presentation/v[23]/.+/manifest",
    r"/iiif/presentation/",
]
# URL fragments, in order, and the provider each stands for.
URL_FRAGMENTS = [
    ("archive.org", "internet_archive"), ("archivelab.org", "internet_archive"), ("gallica.bnf.fr", "bnf_gallica"),
    ("digitale-sammlungen.de", "mdz"), ("hathitrust.org", "hathitrust"), ("loc.gov", "loc"),
    ("wellcomecollection.org", "wellcome"), ("bl.uk", "british_library"), ("e-rara.ch", "e_rara"),
    ("slub-dresden.de", "slub"), ("staatsbibliothek-berlin.de", "sbb_digital"), ("europeana.eu", "europeana"),
    ("polona.pl", "polona"), ("ddb.de", "ddb"), ("deutsche-digitale-bibliothek", "ddb"), ("bne.es", "bne"),
]
# Item ids in URLs, first match wins.
ITEM_ID_PATTERNS = [
    "/iiif/([^/]+)/manifest", "/view/([^/]+)", "/details/([^/]+)", "/item/([^/]+)", "/ark:/[^/]+/([^/]+)",
    r"/presentation/v\d+/([^/]+)", r"/i3f/v\d+/([^/]+)", "([a-zA-Z0-9_-]{5,})$",
]
# Identifier patterns and their providers.
IDENTIFIER_PATTERNS = [
    (r"(?i)^bsb\d+\z", "mdz"), (r"(?i)^bpt6k\w+\z", "bnf_gallica"), (r"(?i)^btv1b\w+\z", "bnf_gallica"),
    (r"(?i)^cb\d+[a-z]?\z", "bnf_gallica"), (r"^ark:/12148/\w+\z", "bnf_gallica"), (r"^mdp\.\w+\z", "hathitrust"),
    (r"^inu\.\w+\z", "hathitrust"), (r"^uc[12]\.\w+\z", "hathitrust"), (r"^hvd\.\w+\z", "hathitrust"),
    (r"^nyp\.\w+\z", "hathitrust"), (r"^njp\.\w+\z", "hathitrust"), (r"^chi\.\w+\z", "hathitrust"),
    (r"^wu\.\w+\z", "hathitrust"), (r"(?i)^vdc_\w+\z", "british_library"),
]
# Hosts of each provider, in the order in which they are tried.
PROVIDER_HOSTS = {
    "gallica": ["gallica.bnf.fr"],
    "british_library": ["api.bl.uk", "sru.bl.uk", "iiif.bl.uk", "access.bl.uk", "bnb.data.bl.uk"],
    "mdz": ["api.digitale-sammlungen.de", "www.digitale-sammlungen.de", "digitale-sammlungen.de"],
    "europeana": ["api.europeana.eu", "iiif.europeana.eu"],
    "wellcome": ["api.wellcomecollection.org", "iiif.wellcomecollection.org"],
    "loc": ["www.loc.gov", "loc.gov", "tile.loc.gov", "iiif.loc.gov"],
    "ddb": ["api.deutsche-digitale-bibliothek.de", "iiif.deutsche-digitale-bibliothek.de", "digi.ub.uni-heidelberg.de", "manifests.sub.uni-goettingen.de"],
    "polona": ["polona.pl"],
    "bne": ["datos.bne.es", "bnedigital.bne.es", "bdh.bne.es"],
    "dpla": ["api.dp.la"],
    "internet_archive": ["archive.org", "archivelab.org", "iiif.archivelab.org"],
    "google_books": ["www.googleapis.com", "books.google.com", "books.googleusercontent.com", "play.google.com"],
    "hathitrust": ["catalog.hathitrust.org", "babel.hathitrust.org"],
    "annas_archive": ["annas-archive.gl", "annas-archive.li", "annas-archive.pm", "annas-archive.in", "annas-archive.org"],
    "slub": ["data.slub-dresden.de", "digital.slub-dresden.de", "iiif.slub-dresden.de"],
    "e_rara": ["www.e-rara.ch", "e-rara.ch"],
    "sbb_digital": ["sru.gbv.de", "digital.staatsbibliothek-berlin.de", "content.staatsbibliothek-berlin.de", "oai.sbb.berlin"],
}
# Names of request parameters and of headers that carry credentials, without case and punctuation.
CREDENTIAL_NAMES = [
    "key", "apikey", "token", "accesstoken", "refreshtoken", "authtoken", "idtoken", "secret", "clientsecret", "password",
    "passwd", "pwd", "auth", "authorization", "credential", "credentials", "sig", "signature", "sessionid",
]
CREDENTIAL_HEADERS = ["authorization", "proxyauthorization", "cookie", "wwwauthenticate"]
CREDENTIAL_ENDS = "(apikey|token|secret|password|signature|credential)$"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def is_manifest_url(url: Column) -> Column:
    u = strip(url)
    return F.coalesce(u.rlike("^https?://") & u.rlike("(?i)" + "|".join(MANIFEST_PATTERNS)), F.lit(False))


def provider_of_url(url: Column) -> Column:
    """The provider whose fragment stands in the URL, else ``direct_iiif``."""
    low, out = F.lower(url), None
    for fragment, provider in URL_FRAGMENTS:
        hit = F.contains(low, F.lit(fragment))
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    return out.otherwise("direct_iiif")


def item_id(url: Column) -> Column:
    """The item id in a URL by the first pattern that matches, else a digest of the URL."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^.*?://", ""), r"(?i)/manifest\.json$", ""), "(?i)/manifest$", "")
    return F.coalesce(*[first_group(rest, p) for p in ITEM_ID_PATTERNS], F.left(F.md5(url), F.lit(12)))


def host_of(url: Column) -> Column:
    """The lower-case host name, without user and port; null where there is none."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_table(spark: SparkSession) -> DataFrame:
    rows = [(h, p, i) for i, (p, hosts) in enumerate(PROVIDER_HOSTS.items()) for h in hosts]
    return spark.createDataFrame(rows, "host string, provider_key string, provider_ord int")


def with_provider_of_host(df: DataFrame, url_col: str, id_col: str) -> DataFrame:
    """(id, url, provider_key): the first provider with a host equal to the URL's or above it.

    The host's suffixes are looked up in a table of fixed size, so it is an equi-join.
    """
    hosts = F.broadcast(host_table(df.sparkSession))
    rows = df.select(F.col(id_col), F.col(url_col), F.explode_outer(host_suffixes(host_of(F.col(url_col)))).alias("host"))
    found = rows.join(hosts, "host", "left").groupBy(id_col, url_col)
    return found.agg(F.min_by("provider_key", "provider_ord").alias("provider_key"))


def providers_of_identifier(identifier: Column) -> Column:
    """Every provider whose pattern the identifier fits, in order, once each."""
    s = strip(identifier)
    hits = F.array(*[F.when(s.rlike(p), F.lit(k)) for p, k in IDENTIFIER_PATTERNS])
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


# Manifest URLs of an identifier, in the order in which they are tried.
MANIFEST_TEMPLATES = [
    ("mdz", 0, "https://api.digitale-sammlungen.de/iiif/presentation/v2/{id}/manifest"),
    ("bnf_gallica", 0, "https://gallica.bnf.fr/iiif/ark:/12148/{id}/manifest.json"),
    ("internet_archive", 0, "https://iiif.archive.org/iiif/{id}/manifest.json"),
    ("internet_archive", 1, "https://iiif.archivelab.org/iiif/{id}/manifest.json"),
    ("e_rara", 0, "https://www.e-rara.ch/i3f/v20/{id}/manifest"),
    ("slub", 0, "https://iiif.slub-dresden.de/iiif/2/{id}/manifest.json"),
    ("loc", 0, "https://www.loc.gov/item/{id}/manifest.json"),
    ("british_library", 0, "https://api.bl.uk/metadata/iiif/ark:/81055/{id}/manifest.json"),
    ("hathitrust", 0, "https://babel.hathitrust.org/cgi/imgsrv/manifest/{id}"),
    ("polona", 0, "https://polona.pl/api/search-service/search/iiif/{id}/manifest.json"),
    ("europeana", 0, "https://iiif.europeana.eu/presentation/{id}/manifest"),
]
# Providers without a manifest URL for an identifier.
NATIVE_PROVIDERS = ["google_books", "annas_archive", "sbb_digital", "wellcome", "dpla", "ddb", "bne"]
# Links of a record and the manifest URL that each gives.
RECORD_LINKS = [
    (r"digi\.ub\.uni-heidelberg\.de/diglit/([^/?#]+)", "https://digi.ub.uni-heidelberg.de/diglit/iiif/{}/manifest.json"),
    (r"resolver\.sub\.uni-goettingen\.de/purl\?([^/&]+)", "https://manifests.sub.uni-goettingen.de/iiif/presentation/{}/manifest"),
    (r"(?:mdz-nbn-resolving\.de|digitale-sammlungen\.de)\S*?(bsb\d+)", "https://api.digitale-sammlungen.de/iiif/presentation/v2/{}/manifest"),
]


def with_manifest_urls(ids: DataFrame, id_col: str, provider_col: str) -> DataFrame:
    """(…, manifest_ord, manifest_url): one row for each template of the row's provider."""
    templates = ids.sparkSession.createDataFrame(MANIFEST_TEMPLATES, f"{provider_col} string, manifest_ord int, template string")
    bare = F.when(F.col(provider_col) == "bnf_gallica", F.regexp_replace(id_col, "^ark:/12148/", "")).otherwise(F.col(id_col))
    return ids.join(F.broadcast(templates), provider_col).withColumn("manifest_url", F.replace(F.col("template"), F.lit("{id}"), bare)).drop("template")


# Identifiers that a query may name outright, and their values.
EXPLICIT_IDS = [("oclc", r"(\d+)"), ("isbn", r"([0-9Xx\-]+)"), ("lccn", r"([0-9A-Za-z\-/.]+)"), ("issn", r"(\d{4}-?\d{3}[0-9Xx])"), ("htid", r"([^\s,;]+)")]


def explicit_ids(text: Column) -> Column:
    """kind -> values that a text names as ``kind: value``; an ISBN loses its hyphens."""
    entries = []
    for kind, value in EXPLICIT_IDS:
        found = F.regexp_extract_all(text, F.lit(rf"(?i){kind}\s*:\s*{value}"), F.lit(1))
        entries += [F.lit(kind), F.transform(found, lambda v: F.replace(v, F.lit("-"), F.lit(""))) if kind == "isbn" else found]
    return F.map_filter(F.create_map(*entries), lambda k, v: F.size(v) > 0)


def is_credential_name(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return key.isin(CREDENTIAL_NAMES) | key.rlike(CREDENTIAL_ENDS)


def carries_credential(url: Column) -> Column:
    """Does a query parameter of the URL carry a credential?"""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("=."))
    return F.coalesce(F.exists(pairs, lambda p: is_credential_name(F.substring_index(p, "=", 1))), F.lit(False))


def header_carries_credential(name: Column, value: Column) -> Column:
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return (F.coalesce(value, F.lit("")) != "") & (key.isin(CREDENTIAL_HEADERS) | is_credential_name(name))


def manifest_of_record_link(url: Column, templates: list[tuple[str, str]] = RECORD_LINKS) -> Column:
    """The first (pattern, template) whose pattern matches gives its template with ``{}`` filled."""
    return F.coalesce(*[F.when(url.rlike(p), F.replace(F.lit(t), F.lit("{}"), F.regexp_extract(url, p, 1))) for p, t in templates])

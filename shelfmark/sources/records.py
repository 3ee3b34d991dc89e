"""Captured provider responses into candidate records.

A response table has a key, a provider and a body.  JSON bodies become variants, SRU and
HTML bodies go once through a small Arrow UDF.  A malformed body or
record gives no row and never fails the others.  Every parser returns the same columns:
key, hit_ix, title, creators, date, source_id, iiif_manifest, item_url, thumbnail_url.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.ids import first_group
from ..functions.text import split_creators, strip, strip_tags, with_once
from ..operators.iiif import node, text_at

NO_LIST = "cast(array() as array<string>)"
FIELDS = ("title", "creators", "date", "source_id", "iiif_manifest", "item_url", "thumbnail_url")


def scalar(v: Column, path: str) -> Column:
    """A string or number at a path as text; null where it is missing, empty, a list or an object."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    plain = ~(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")) | kind.isin("BOOLEAN", "VOID"))
    return F.when(plain, F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def first_or_scalar(v: Column, path: str) -> Column:
    """The value at a path, or the first of a list there."""
    return F.coalesce(scalar(v, path), scalar(v, f"{path}[0]"))


def text_list(v: Column, path: str) -> Column:
    """A list of texts, or the one text, at a path; empty where there is none."""
    many = F.filter(F.try_variant_get(v, path, "array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(many, F.when(scalar(v, path).isNotNull(), F.array(scalar(v, path))), F.expr(NO_LIST))


def one(creator: Column) -> Column:
    """A single creator text as a list: split at ``;`` only."""
    return split_creators(creator)


def url(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), value))


def first_text(items: Column, pick: Callable[[Column], Column]) -> Column:
    """The first picked text over an array of variants."""
    return F.get(F.filter(F.transform(items, pick), lambda x: x.isNotNull()), F.lit(0))


def record(title=None, creators=None, date=None, source_id=None, iiif_manifest=None, item_url=None, thumbnail_url=None) -> dict[str, Column]:
    given = locals()
    none = F.lit(None).cast("string")
    out = {k: none if given[k] is None else given[k] for k in FIELDS}
    return out | {"title": F.coalesce(out["title"], F.lit("")), "creators": F.expr(NO_LIST) if creators is None else creators}


def normalized(r: Column) -> dict[str, Column]:
    """A generic record: the first filled key of each kind; creators by the first key that is present."""
    def present(key: str) -> Column:
        return node(r, f"$.{key}").isNotNull() & (F.schema_of_variant(node(r, f"$.{key}")) != "VOID")

    def people(key: str) -> Column:
        return F.when(scalar(r, f"$.{key}").isNotNull(), one(scalar(r, f"$.{key}"))).otherwise(text_list(r, f"$.{key}"))

    creators = F.when(present("creators"), people("creators")).when(present("creator"), people("creator")).when(present("contributor_names"), people("contributor_names")).otherwise(F.expr(NO_LIST))
    pick = lambda *keys: F.coalesce(*[scalar(r, f"$.{k}") for k in keys])
    return record(
        pick("title", "name", "label"), creators, pick("date", "year", "issued", "publication_date"), pick("id", "identifier", "ark_id", "source_id", "uid"),
        pick("iiif_manifest", "manifest"), pick("item_url", "url", "guid"), pick("thumbnail", "thumbnail_url", "image"),
    )


def chosen_source_id(source_id: Column, raw: Column) -> Column:
    """A selected record's id: its own, else the raw record's identifier or ark."""
    return F.coalesce(F.nullif(source_id, F.lit("")), scalar(raw, "$.identifier"), scalar(raw, "$.ark_id"))


def _internet_archive(r: Column):
    name = scalar(r, "$.identifier")
    return record(scalar(r, "$.title"), text_list(r, "$.creator"), scalar(r, "$.year"), name, None, url("https://archive.org/details/", name))


def _loc(r: Column):
    raw = scalar(r, "$.id")
    item = F.element_at(F.split(F.trim(raw, F.lit("/")), "/"), -1)
    listed = first_text(F.try_variant_get(r, "$.resources", "array<variant>"), lambda x: scalar(x, "$.iiif_manifest"))
    manifest = F.coalesce(scalar(r, "$.iiif_manifest_url"), listed, scalar(r, "$.resources.iiif_manifest"))
    return record(scalar(r, "$.title"), one(first_or_scalar(r, "$.contributor_names")), F.coalesce(scalar(r, "$.date"), first_or_scalar(r, "$.dates")), item, manifest, scalar(r, "$.url"))


def _europeana(r: Column):
    views = F.coalesce(F.try_variant_get(r, "$.edmAggregatedCHO.hasView", "array<variant>"), F.array(node(r, "$.edmAggregatedCHO.hasView")))
    seen = first_text(views, lambda v: F.get(F.filter(F.array(text_at(v, "$"), text_at(v, "$['@id']")), lambda x: F.contains(x, F.lit("manifest"))), F.lit(0)))
    thing = text_at(r, "$.object")
    name = scalar(r, "$.id")
    parts = F.filter(F.split(name, "/"), lambda x: x != "")
    built = F.when(F.size(parts) >= 2, F.concat(F.lit("https://iiif.europeana.eu/presentation/"), F.element_at(parts, F.greatest(F.lit(1), F.size(parts) - 1)), F.lit("/"), F.element_at(parts, F.size(parts)), F.lit("/manifest?format=3")))
    manifest = F.coalesce(seen, F.when(F.contains(thing, F.lit("manifest")), thing), built)
    return record(first_or_scalar(r, "$.title"), one(first_or_scalar(r, "$.dcCreator")), first_or_scalar(r, "$.year"), name, manifest, scalar(r, "$.guid"))


def _dpla(r: Column):
    views = F.coalesce(F.try_variant_get(r, "$.hasView", "array<variant>"), F.array(node(r, "$.hasView")))
    nested = F.flatten(F.transform(views, lambda v: F.array(text_at(v, "$"), text_at(v, "$['@id']"), text_at(v, "$.id"), text_at(v, "$.url"))))
    links = F.concat(F.array(*[text_at(r, f"$.{k}") for k in ("object", "isShownAt", "isShownBy")]), F.coalesce(nested, F.expr(NO_LIST)))
    manifest = F.get(F.filter(links, lambda u: F.contains(u, F.lit("manifest")) & F.contains(u, F.lit("iiif"))), F.lit(0))
    date = F.coalesce(*[scalar(r, f"$.sourceResource.date{p}{k}") for p in ("", "[0]") for k in (".displayDate", ".begin")], first_or_scalar(r, "$.sourceResource.date"))
    return record(first_or_scalar(r, "$.sourceResource.title"), text_list(r, "$.sourceResource.creator"), date, scalar(r, "$.id"), manifest, scalar(r, "$.isShownAt"))


def _ddb(r: Column):
    title = F.regexp_replace(F.coalesce(first_or_scalar(r, "$.label"), first_or_scalar(r, "$.title")), "</?match>", "")
    role = r"^(.*?)\s*\((?:Verfasser|Autor)\S*\)$"
    writers = F.transform(F.try_variant_get(r, "$.view", "array<string>"), lambda x: F.nullif(strip(F.coalesce(first_group(strip(x), role), F.lit(""))), F.lit("")))
    writer = F.get(F.filter(writers, lambda x: x.isNotNull()), F.lit(0))
    name = scalar(r, "$.id")
    return record(title, one(writer), None, name, None, url("https://www.deutsche-digitale-bibliothek.de/item/", name), scalar(r, "$.thumbnail"))


def _mdz(r: Column):
    name = scalar(r, "$.id")
    return record(strip_tags(first_or_scalar(r, "$.title")), text_list(r, "$.authors"), scalar(r, "$.publicationDate"), name, None, url("https://www.digitale-sammlungen.de/view/", name))


def _polona(r: Column):
    def first(field: str) -> Column:
        return F.get(F.filter(F.try_variant_get(r, f"$.{field}.values", "array<string>"), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))

    thumb = scalar(r, "$.attributes.thumbnail.stringValue")
    thumb = F.when(F.startswith(thumb, F.lit("/")), F.concat(F.lit("https://polona.pl/api"), thumb)).otherwise(thumb)
    name = scalar(r, "$.objectId")
    return record(first("basicFields.title"), one(first("basicFields.creatorForSearch")), F.coalesce(first("basicFields.dateDescriptive"), first("hiddenFields.date")), name, None, url("https://polona.pl/item/", name), thumb)


def _google_books(r: Column):
    name = scalar(r, "$.id")
    return record(scalar(r, "$.volumeInfo.title"), text_list(r, "$.volumeInfo.authors"), scalar(r, "$.volumeInfo.publishedDate"), name, None, url("https://books.google.com/books?id=", name))


def google_free(r: Column) -> Column:
    """Is a volume clearly free: a download link, in the public domain, or in full view?"""
    link = F.coalesce(scalar(r, "$.accessInfo.pdf.downloadLink"), scalar(r, "$.accessInfo.epub.downloadLink")).isNotNull()
    view = F.lower(F.coalesce(scalar(r, "$.accessInfo.viewability"), scalar(r, "$.volumeInfo.viewability"), F.lit("")))
    return link | F.coalesce(F.try_variant_get(r, "$.accessInfo.publicDomain", "boolean"), F.lit(False)) | view.rlike("all_pages|full")


def _wellcome(r: Column):
    manifest = F.get(wellcome_locations(r, "iiif-presentation"), F.lit(0))
    person = first_text(F.try_variant_get(r, "$.contributors", "array<variant>"), lambda c: scalar(c, "$.agent.label"))
    dates = F.flatten(F.transform(F.try_variant_get(r, "$.production", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.dates", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    name = scalar(r, "$.id")
    return record(scalar(r, "$.title"), one(strip(person)), strip(first_text(dates, lambda d: scalar(d, "$.label"))), name, manifest, url("https://wellcomecollection.org/works/", name), scalar(r, "$.thumbnail.url"))


def wellcome_locations(r: Column, kind: str) -> Column:
    """The distinct URLs of an item's locations of one kind; image services lose their ``/info.json``."""
    places = F.flatten(F.transform(F.try_variant_get(r, "$.items", "array<variant>"), lambda i: F.coalesce(F.try_variant_get(i, "$.locations", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    found = F.transform(F.filter(places, lambda p: scalar(p, "$.locationType.id") == kind), lambda p: scalar(p, "$.url"))
    found = F.array_distinct(F.filter(found, lambda u: u.isNotNull()))
    if kind == "iiif-image":
        found = F.transform(F.filter(found, lambda u: F.endswith(u, F.lit("/info.json"))), lambda u: F.regexp_replace(u, "/info\\.json$", ""))
    return F.coalesce(found, F.expr(NO_LIST))


def _slub(r: Column):
    title = F.coalesce(scalar(r, "$.title.mainTitle"), scalar(r, "$.title.preferredName"), scalar(r, "$.title"), scalar(r, "$.preferredName"))
    person = first_text(F.try_variant_get(r, "$.contributor", "array<variant>"), lambda c: scalar(c, "$.name"))
    raw = F.coalesce(scalar(r, "$['@id']"), scalar(r, "$.id"))
    return record(title, one(person), None, F.element_at(F.split(F.rtrim(raw, F.lit("/")), "/"), -1))


def slub_online(r: Column) -> Column:
    mode, kind = F.lower(F.coalesce(scalar(r, "$.accessMode"), F.lit(""))), F.lower(F.coalesce(scalar(r, "$.reproductionType"), F.lit("")))
    return (mode == "") | (mode == "online") | F.contains(kind, F.lit("online"))


def ppn_of_url(text: Column) -> Column:
    """The PPN in a URL, with its check digit."""
    return F.coalesce(first_group(text, r"(?i)ppn(\d+[\dxX]?)"), first_group(text, r"(?i)id(\d+[\dxX]?)"))


def _bne(r: Column):
    value = lambda k: scalar(r, f"$.{k}.value")
    uuid = F.lower(first_group(value("digital"), "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"))
    return record(value("title"), one(value("creator")), value("date"), uuid, None, value("digital"))


def _bnb(r: Column):
    """A binding of the British Library's linked data: the first of its links that names an ark."""
    value = lambda k: scalar(r, f"$.{k}.value")
    ark = F.coalesce(*[first_group(value(k), r"ark:/81055/([^\s\"'<>]+)") for k in ("same", "ident", "work")])
    return record(value("title"), one(value("creatorName")), None, ark)


def catalogue_id(value: Column) -> Column:
    """A catalogue resource's bare id from its URI or the id itself."""
    v = strip(value)
    last = F.element_at(F.split(F.rtrim(v, F.lit("/")), "/"), -1)
    bare = F.when(F.startswith(v, F.lit("http")), F.when(F.contains(v, F.lit("datos.bne.es")), last)).otherwise(v)
    return F.when(bare.rlike("^[A-Za-z]{1,4}[0-9]+$"), bare)


#: provider -> (path of its hits, record, filter).  Each hit of a doubly nested path is flattened.
JSON_PROVIDERS: dict[str, tuple[tuple[str, ...], Callable, Callable | None]] = {
    "internet_archive": (("$.response.docs",), _internet_archive, None),
    "loc": (("$.results",), _loc, None),
    "europeana": (("$.items",), _europeana, None),
    "dpla": (("$.docs",), _dpla, None),
    "ddb": (("$.results", "$.docs"), _ddb, None),
    "mdz": (("$.docs",), _mdz, lambda r: F.coalesce(F.try_variant_get(r, "$.iiifAvailable", "boolean"), F.lit(True)) & scalar(r, "$.id").isNotNull()),
    "polona": (("$.hits",), _polona, lambda r: scalar(r, "$.objectId").isNotNull()),
    "google_books": (("$.items",), _google_books, google_free),
    "wellcome": (("$.results",), _wellcome, lambda r: (F.size(wellcome_locations(r, "iiif-image")) > 0) | (F.size(wellcome_locations(r, "iiif-presentation")) > 0)),
    "slub": (("$",), _slub, slub_online),
    "british_library": (("$.results.bindings",), _bnb, lambda r: _bnb(r)["source_id"].isNotNull()),
    "bne": (("$.results.bindings",), _bne, lambda r: F.coalesce(scalar(r, "$.digital.value"), F.lit("")).rlike("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")),
}


def _hits(provider: Column, r: Column) -> Column:
    """The hits of a response: the array at its provider's path, a doubly nested one flattened."""

    def listed(path: str):
        return lambda x: F.coalesce(F.try_variant_get(x, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))

    out = None
    for name, (paths, _, _) in JSON_PROVIDERS.items():
        found = F.try_variant_get(r, paths[0], "array<variant>")
        for path in paths[1:]:
            found = F.flatten(F.transform(found, listed(path)))
        out = F.when(provider == name, found) if out is None else out.when(provider == name, found)
    return out


def all_json_records(responses: DataFrame, provider: str, key: str, body: str) -> DataFrame:
    """The records of JSON responses of any provider, each response parsed once and each hit read by its own provider's rules."""
    who, r = F.col(provider), F.col("r")
    rows = with_once(responses.filter(who.isin(*JSON_PROVIDERS)), "_v", F.try_parse_json(F.col(body)))
    rows = rows.select(provider, key, F.posexplode(_hits(who, F.col("_v"))).alias("pos", "r"))
    keep = F.lit(True)
    for name, (_, _, test) in JSON_PROVIDERS.items():
        if test:
            keep = F.when(who == name, test(r)).otherwise(keep)
    rows = rows.filter(F.startswith(F.schema_of_variant(r), F.lit("OBJECT")) & keep)
    rows = with_once(rows, "_f", by_provider(who, {name: build(r) for name, (_, build, _) in JSON_PROVIDERS.items()}))
    rows = rows.filter(~who.isin("bne", "slub") | F.col("_f.source_id").isNotNull())
    # an item of bne counts once a response
    same = Window.partitionBy(provider, key, F.when(who == "bne", F.col("_f.source_id")).otherwise(F.col("pos").cast("string"))).orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    hit = F.row_number().over(Window.partitionBy(provider, key).orderBy("pos")) - 1
    return rows.select(provider, key, "_f.*", hit.alias("hit_ix"))


def json_records(responses: DataFrame, provider: str, key: str, body: str) -> DataFrame:
    """The records of one provider's JSON responses."""
    return all_json_records(responses.select(F.lit(provider).alias("_provider"), key, body), "_provider", key, body).drop("_provider")


def hathi_records(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Bibliographic records with the first item id and the first item URL that name each of them."""
    base = responses.select(key, F.try_parse_json(F.col(body)).alias("r"))
    recs = base.select(key, F.posexplode(F.map_entries(F.try_variant_get(F.col("r"), "$.records", "map<string,variant>"))).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("rec"), F.col("e.value").alias("v"))
    items = base.select(key, F.posexplode(F.try_variant_get(F.col("r"), "$.items", "array<variant>")).alias("at", "i"))
    item = F.col("i")
    first = items.select(F.col(key).alias("_k"), scalar(item, "$.fromRecord").alias("_rec"), "at", scalar(item, "$.htid").alias("htid"), scalar(item, "$.itemURL").alias("link")).groupBy("_k", "_rec").agg(
        F.min_by("htid", F.when(F.col("htid").isNotNull(), F.col("at"))).alias("htid"), F.min_by("link", F.when(F.col("link").isNotNull(), F.col("at"))).alias("link")
    )
    v = F.col("v")
    fields = record(
        F.coalesce(first_or_scalar(v, "$.titles"), first_or_scalar(v, "$.title")),
        F.when(F.size(text_list(v, "$.authors")) > 0, text_list(v, "$.authors")).otherwise(text_list(v, "$.mainAuthor")),
        F.coalesce(*[first_or_scalar(v, f"$.{k}") for k in ("pubDate", "publishDates", "date")]),
        F.coalesce("htid", "rec"), None, F.col("link"),
    )
    out = recs.join(first, (F.col(key) == F.col("_k")) & (F.col("rec") == F.col("_rec")), "left").select(key, "pos", *[c.alias(k) for k, c in fields.items()])
    return out.withColumn("hit_ix", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).drop("pos")


def step(*names: str) -> str:
    """XPath steps by local name, which fit default and prefixed namespaces alike."""
    return "".join(f"/*[local-name()='{n}']" for n in names)


def clean(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def xml_at(xml: Column, path: str) -> Column:
    """The first text at a path."""
    return F.get(xml_all(xml, path), F.lit(0))


def xml_all(xml: Column, path: str) -> Column:
    return F.transform(F.xpath(xml, F.lit(f"{path}/text()")), strip)


def xml_parts(xml: Column, name: str) -> Column:
    """The elements of one local name as XML texts, by their tags (they do not nest in themselves)."""
    tag = rf"(?:[\w.-]+:)?{name}"
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)"), F.lit(1))


def declared(part: Column) -> Column:
    """An XML part as a document of its own: prefixes are dropped, as local names are all that is read."""
    # each rule holds inside a tag alone: what follows, quoted values whole, leads to its end
    inside = r"(?=(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>)"
    bare = F.regexp_replace(part, r"\sxmlns(?::[\w.-]+)?\s*=\s*(\"[^\"]*\"|'[^']*')" + inside, "")
    return F.regexp_replace(F.regexp_replace(bare, r"(</?)[\w.-]+:", "$1"), r"\s[\w.-]+:([\w.-]+\s*=)(?=\s*[\"'])" + inside, " $1")


def _mods_fields(x: Column) -> dict[str, Column]:
    title = F.coalesce(clean(xml_at(x, f"/{step('mods')}{step('titleInfo', 'title')}")), F.lit(""))
    names = [xml_at(x, f"/{step('mods')}{step('name', k)}") for k in ("displayForm", "namePart")]
    return {"title": title, "creator": F.coalesce(*[clean(n) for n in names]), "date": clean(xml_at(x, f"/{step('mods')}{step('originInfo', 'dateIssued')}"))}


def mods_creator(xml: Column) -> Column:
    """The creator of a MODS record: its own name elements only, display form before name part."""
    return _mods_fields(xml)["creator"]


#: What one record of an SRU response says, whatever its format; texts are stripped, empty ones null.
XML_RECORD = StructType([
    *[StructField(n, StringType()) for n in ("title", "sub_title", "date", "display_form", "name_part", "extra_id", "prefix", "ppn", "record_id")],
    *[StructField(n, ArrayType(StringType())) for n in ("creators", "identifiers")],
])
#: Providers whose records are MODS; those of the others are Dublin Core.
MODS_PROVIDERS = ("e_rara", "sbb_digital")
SRU_PROVIDERS = ("bnf_gallica", "british_library", *MODS_PROVIDERS)


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _under(elements: list, *names: str) -> list:
    """The elements that lie under ``elements`` along these local names."""
    for name in names:
        elements = [c for e in elements for c in e if _local(c.tag) == name]
    return elements


def _texts(elements: list) -> list[str]:
    return [t for e in elements if (t := (e.text or "").strip())]


def _first(elements: list) -> str | None:
    return next(iter(_texts(elements)), None)


def _dublin_core(record) -> dict:
    inside = list(record)
    title = _under(inside, "title")
    return {"title": _first(title[:1]), "date": _first(_under(inside, "date")), "creators": _texts(_under(inside, "creator")), "identifiers": _texts(_under(inside, "identifier"))}


def _mods(record) -> dict | None:
    mods = next((e for e in record.iter() if _local(e.tag) == "mods"), None)
    if mods is None:
        return None
    ids = _under([mods], "recordInfo", "recordIdentifier")
    marked = [e for e in ids if any(_local(k) == "source" and "ppn" in v.lower() for k, v in e.attrib.items())]
    extra = [e for e in record if _local(e.tag) == "extraRecordData"]
    return {
        "title": _first(_under([mods], "titleInfo", "title")), "sub_title": _first(_under([mods], "titleInfo", "subTitle")), "date": _first(_under([mods], "originInfo", "dateIssued")),
        "display_form": _first(_under([mods], "name", "displayForm")), "name_part": _first(_under([mods], "name", "namePart")),
        "extra_id": _first(_under(extra, "id")), "prefix": _first(_under(extra, "prefix")), "ppn": _first(marked), "record_id": _first(ids),
    }


@F.pandas_udf(ArrayType(XML_RECORD))
def xml_records(provider: pd.Series, body: pd.Series) -> pd.Series:
    """The records of SRU responses, each response parsed once; one that is no XML has none."""

    def records(who: str | None, text: str | None) -> list[dict]:
        try:
            root = ElementTree.fromstring(text or "")
        except (ElementTree.ParseError, ValueError):
            return []
        name, read = ("record", _mods) if who in MODS_PROVIDERS else ("recordData", _dublin_core)
        found = [read(e) for e in root.iter() if _local(e.tag) == name]
        return [{n: r.get(n) for n in XML_RECORD.names} for r in found if r is not None]

    return pd.Series([records(p, b) for p, b in zip(provider, body, strict=True)], dtype=object)


def _sru_fields(x: Column) -> dict[str, dict[str, Column]]:
    """provider -> the candidate's fields out of an XML record."""
    ids, people = x["identifiers"], F.coalesce(x["creators"], F.expr(NO_LIST))
    title, date = F.coalesce(x["title"], F.lit("")), x["date"]
    ark = F.get(F.filter(F.transform(ids, lambda i: first_group(i, "ark:/12148/([a-zA-Z0-9]+)")), lambda i: i.isNotNull()), F.lit(0))
    writer = one(F.coalesce(x["display_form"], x["name_part"]))
    rara = F.when(x["prefix"].isNotNull(), F.concat(F.lit("https://www.e-rara.ch/"), x["prefix"], F.lit("/content/titleinfo/"), x["extra_id"]))
    ppn = F.coalesce(x["ppn"], x["record_id"])
    ppn = F.when(F.upper(ppn).startswith("PPN"), ppn).otherwise(F.concat(F.lit("PPN"), ppn))
    return {
        "bnf_gallica": record(title, people, date, ark, None, url("https://gallica.bnf.fr/ark:/12148/", ark)),
        "british_library": record(title, one(F.get(people, F.lit(0))), date, first_group(F.get(ids, F.lit(0)), r"ark:/81055/([^\s/?#]+)")),
        "e_rara": record(title, writer, date, x["extra_id"], F.concat(F.lit("https://www.e-rara.ch/i3f/v20/"), x["extra_id"], F.lit("/manifest")), rara),
        "sbb_digital": record(F.concat_ws(" ", title, x["sub_title"]), writer, date, ppn, None, url("https://digital.staatsbibliothek-berlin.de/werkansicht?PPN=", ppn)),
    }


def by_provider(provider: Column, fields: dict[str, dict[str, Column]]) -> Column:
    """One struct: the fields of the row's own provider; only they are computed."""
    out = None
    for name, columns in fields.items():
        made = F.struct(*[columns[k].alias(k) for k in FIELDS])
        out = F.when(provider == name, made) if out is None else out.when(provider == name, made)
    return out


def all_sru_records(responses: DataFrame, provider: str, key: str, body: str) -> DataFrame:
    """Records of SRU responses of any provider: ``bnf_gallica``, ``british_library`` (Dublin Core), ``e_rara``, ``sbb_digital`` (MODS)."""
    rows = responses.filter(F.col(provider).isin(*SRU_PROVIDERS)).select(provider, key, F.posexplode(xml_records(F.col(provider), F.col(body))).alias("pos", "x"))
    rows = with_once(rows, "_f", by_provider(F.col(provider), _sru_fields(F.col("x")))).filter("_f.source_id is not null")
    hit = F.row_number().over(Window.partitionBy(provider, key).orderBy("pos")) - 1
    return rows.select(provider, key, "_f.*", hit.alias("hit_ix"))


def sru_records(responses: DataFrame, provider: str, key: str, body: str) -> DataFrame:
    """The records of one provider's SRU responses."""
    return all_sru_records(responses.select(F.lit(provider).alias("_provider"), key, body), "_provider", key, body).drop("_provider")


# METS file groups, best resolution first.
GROUP_ORDER = ["MAX", "DEFAULT", "PRESENTATION", "MIN", "THUMBS"]


def mets_files(responses: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, use, url, ord): the PDFs, and the images of the best file group that has any (of all where none is known)."""
    x = F.regexp_replace(declared(F.col(body)), r"<\?xml[^>]*\?>", "")
    groups = responses.select(key, F.posexplode(xml_parts(x, "fileGrp")).alias("g", "grp"))
    use = F.upper(F.regexp_extract("grp", r"^<fileGrp[^>]*\sUSE\s*=\s*[\"']([^\"']*)", 1))
    files = groups.select(key, "g", use.alias("use"), F.posexplode(xml_parts(F.col("grp"), "file")).alias("f", "file"))
    kind = F.lower(F.regexp_extract("file", r"^<file[^>]*\sMIMETYPE\s*=\s*[\"']([^\"']*)", 1))
    href = F.regexp_extract("file", r"<FLocat[^>]*\shref\s*=\s*[\"']([^\"']*)", 1)
    files = files.select(key, "g", "f", "use", kind.alias("mime"), F.replace(href, F.lit("&amp;"), F.lit("&")).alias("url")).filter("url <> ''")
    low = F.lower(F.col("url"))
    pdf = F.contains(F.col("mime"), F.lit("pdf")) | low.endswith(".pdf")
    image = F.contains(F.col("mime"), F.lit("image")) | low.rlike(r"\.(jpg|jpeg|png|tif|tiff|jp2)$")
    files = files.withColumn("kind", F.when(pdf, "pdf").when(image, "image")).filter("kind is not null")
    place = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("use"))
    files = files.withColumn("place", F.when((F.col("kind") == "image") & (place > 0), place))
    best = F.min("place").over(Window.partitionBy(key))
    files = files.withColumn("best", best).filter((F.col("kind") == "pdf") | F.col("best").isNull() | (F.col("place") == F.col("best")))
    order = Window.partitionBy(key, "kind").orderBy("g", "f")
    return files.withColumn("ord", F.row_number().over(order)).select(key, "kind", "use", "url", "ord")


class _Links(HTMLParser):
    """The links of a page with their texts, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self._close()
            self.href = href

    def handle_endtag(self, tag):
        if tag == "a":
            self._close()

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def _close(self):
        if self.href is not None:
            self.found.append((self.href, "".join(t.strip() for t in self.text)))
        self.href, self.text = None, []


@F.pandas_udf(ArrayType(StructType([StructField("href", StringType()), StructField("label", StringType())])))
def html_links(body: pd.Series) -> pd.Series:
    """The links of HTML pages as (href, text); a null page has none."""

    def links(page: str | None):
        parser = _Links()
        parser.feed(page or "")
        parser.close()
        parser._close()
        return [{"href": h, "label": t} for h, t in parser.found]

    return body.map(links)


def viewer_links(pages: DataFrame, key: str, body: str, creator: Column | None = None) -> DataFrame:
    """Search results of an HTML page of viewer links, each object once."""
    rows = pages.select(key, F.posexplode(html_links(F.col(body))).alias("pos", "a"), *([creator.alias("_by")] if creator is not None else []))
    rows = rows.withColumn("source_id", first_group(F.col("a.href"), "/(?:(?:en|de)/)?view/([^/?#]+)")).filter("source_id is not null")
    once = Window.partitionBy(key, "source_id").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    fields = record(F.col("a.label"), one(F.col("_by")) if creator is not None else None, None, F.col("source_id"), None, url("https://www.digitale-sammlungen.de/view/", F.col("source_id")))
    return rows.select(key, "pos", *[c.alias(k) for k, c in fields.items()]).withColumn("hit_ix", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).drop("pos")


def digest_links(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, digest, label, ord): links that carry an MD5 digest, each digest once."""
    rows = pages.select(key, F.posexplode(html_links(F.col(body))).alias("pos", "a"))
    rows = rows.select(key, "pos", F.lower(first_group(F.col("a.href"), "/md5/([0-9a-fA-F]{32})(?:[?/]|$)")).alias("digest"), F.col("a.label").alias("label")).filter("digest is not null")
    once = Window.partitionBy(key, "digest").orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).select(key, "digest", "label", "ord")

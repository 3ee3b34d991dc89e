"""Queries over captured provider responses, built from documents in each provider's own shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dialects
from ..sources import records as rec
from .registry import query
from .views import table

#: Documents of one response.
PAGE = 40
BASE = "base AS (SELECT doc_id, doc_id // 40 AS resp, doc_id % 40 AS pos, trim(regexp_extract(text, '^[^.!?\n]*', 0), ' ') AS title, source AS person, CAST(1600 + doc_id % 400 AS VARCHAR) AS year, 'd' || doc_id AS id FROM documents)"


def base(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(d / PAGE).alias("resp"), F.trim(F.regexp_extract("text", "^[^.!?\n]*", 0)).alias("title"), F.col("source").alias("person"), (1600 + d % 400).cast("string").alias("year"), F.concat(F.lit("d"), d).alias("id"))


def field(name: str, sql: str):
    return F.expr(sql).alias(name)


#: provider -> (hit as a struct, wrapping of the list of hits)
SHAPES = {
    "internet_archive": ("struct(title, id as identifier, if(doc_id % 2 = 0, array(person, year), null) as creator, cast(year as int) as year)", '{{"response":{{"docs":{0}}}}}'),
    "loc": ("struct(title, concat('http://www.loc.gov/item/', id, '/') as id, array(person, 'x') as contributor_names, array(year) as dates, concat('u', id) as url, array(struct(if(doc_id % 2 = 0, concat('m', id), null) as iiif_manifest)) as resources)", '{{"results":{0}}}'),
    "europeana": ("struct(array(title) as title, concat('/', resp, '/', id) as id, array(person) as dcCreator, array(year) as year, concat('g', id) as guid, if(doc_id % 2 = 0, concat('http://x/manifest/', id), null) as object)", '{{"success":true,"items":{0}}}'),
    "dpla": ("struct(id, struct(array(title) as title, array(person) as creator, array(struct(year as displayDate)) as date) as sourceResource, concat('s', id) as isShownAt, array(struct(concat('http://iiif/', id, '/manifest') as url)) as hasView)", '{{"docs":{0}}}'),
    "ddb": ("struct(id, concat('<match>', title, '</match>') as label, array('x', concat(person, ' (Verfasser)')) as view, concat('t', id) as thumbnail)", '{{"results":[{{"docs":null}},{{"docs":{0}}}]}}'),
    "mdz": ("struct(id, concat('<em>', title, '</em>') as title, array(person, year) as authors, year as publicationDate, doc_id % 3 > 0 as iiifAvailable)", '{{"docs":{0}}}'),
    "polona": ("struct(id as objectId, struct(struct(array('', title) as values) as title, struct(array(person) as values) as creatorForSearch) as basicFields, struct(struct(array(year) as values) as date) as hiddenFields, struct(struct(concat('/t/', id) as stringValue) as thumbnail) as attributes)", '{{"hits":{0}}}'),
    "google_books": ("struct(id, struct(title, array(person) as authors, year as publishedDate) as volumeInfo, struct(if(doc_id % 3 = 0, 'ALL_PAGES', 'PARTIAL') as viewability, doc_id % 3 = 1 as publicDomain) as accessInfo)", '{{"items":{0}}}'),
    "wellcome": ("struct(id, title, array(struct(struct(person as label) as agent)) as contributors, array(struct(array(struct(concat('[', year, ']') as label)) as dates)) as production, array(struct(array(struct(struct(if(doc_id % 3 = 0, 'iiif-image', if(doc_id % 3 = 1, 'iiif-presentation', 'shelf')) as id) as locationType, concat('https://l/', id, '/info.json') as url)) as locations)) as items)", '{{"results":{0}}}'),
    "slub": ("struct(concat('https://data/', id) as `@id`, struct(title as preferredName) as title, array(struct(person as name)) as contributor, if(doc_id % 2 = 0, 'Online', 'print') as accessMode)", "{0}"),
    "british_library": ("struct(struct(title as value) as title, struct(person as value) as creatorName, if(doc_id % 3 = 0, struct(concat('http://x/ark:/81055/', id, ' z') as value), struct('http://other/' as value)) as same, if(doc_id % 3 < 2, struct(concat('ark:/81055/i', id) as value), null) as ident)", '{{"results":{{"bindings":{0}}}}}'),
    "bne": ("struct(struct(title as value) as title, struct(person as value) as creator, struct(year as value) as date, struct(concat('http://bd/card?id=', lower(concat_ws('-', '0000ABCD', '0000', '0000', '0000', lpad(cast(doc_id div 2 as string), 12, '0'))))  as value) as digital)", '{{"results":{{"bindings":{0}}}}}'),
}


def responses(spark, sf_dir) -> DataFrame:
    """(provider_key, resp, body) of all JSON providers, from one scan of the documents."""
    each = F.array(*[F.struct(F.lit(p).alias("provider_key"), F.to_json(F.expr(shape)).alias("j")) for p, (shape, _) in SHAPES.items()])
    hits = base(spark, sf_dir).select("resp", "doc_id", F.explode(each).alias("h")).select("h.*", "resp", "doc_id")
    hits = hits.groupBy("provider_key", "resp").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "j"))), lambda x: x["j"]).alias("hits"))
    ends = {p: wrap.format("\x00").split("\x00") for p, (_, wrap) in SHAPES.items()}
    before, after = (F.create_map(*[F.lit(x) for p, e in ends.items() for x in (p, e[i])])[F.col("provider_key")] for i in range(2))
    # a malformed hit in the middle of every list
    body = F.concat(before, F.lit("[7,"), F.array_join("hits", ","), F.lit("]"), after)
    return hits.select("provider_key", "resp", F.when(F.col("resp") % 20 == 19, "broken {").otherwise(body).alias("body"))


EXPECTED = {
    "internet_archive": ("title", "CASE WHEN doc_id % 2 = 0 THEN person || '|' || year ELSE '' END", "year", "id", "NULL", "'https://archive.org/details/' || id", "NULL", "TRUE"),
    "loc": ("title", "person", "year", "id", "CASE WHEN doc_id % 2 = 0 THEN 'm' || id END", "'u' || id", "NULL", "TRUE"),
    "europeana": ("title", "person", "year", "'/' || resp || '/' || id", "CASE WHEN doc_id % 2 = 0 THEN 'http://x/manifest/' || id ELSE 'https://iiif.europeana.eu/presentation/' || resp || '/' || id || '/manifest?format=3' END", "'g' || id", "NULL", "TRUE"),
    "dpla": ("title", "person", "year", "id", "'http://iiif/' || id || '/manifest'", "'s' || id", "NULL", "TRUE"),
    "ddb": ("title", "person", "NULL", "id", "NULL", "'https://www.deutsche-digitale-bibliothek.de/item/' || id", "'t' || id", "TRUE"),
    "mdz": ("title", "person || '|' || year", "year", "id", "NULL", "'https://www.digitale-sammlungen.de/view/' || id", "NULL", "doc_id % 3 > 0"),
    "polona": ("title", "person", "year", "id", "NULL", "'https://polona.pl/item/' || id", "'https://polona.pl/api/t/' || id", "TRUE"),
    "google_books": ("title", "person", "year", "id", "NULL", "'https://books.google.com/books?id=' || id", "NULL", "doc_id % 3 < 2"),
    "wellcome": ("title", "person", "'[' || year || ']'", "id", "CASE WHEN doc_id % 3 = 1 THEN 'https://l/' || id || '/info.json' END", "'https://wellcomecollection.org/works/' || id", "NULL", "doc_id % 3 < 2"),
    "slub": ("title", "person", "NULL", "id", "NULL", "NULL", "NULL", "doc_id % 2 = 0"),
    "british_library": ("title", "person", "NULL", "CASE WHEN doc_id % 3 = 0 THEN id ELSE 'i' || id END", "NULL", "NULL", "NULL", "doc_id % 3 < 2"),
    "bne": ("title", "person", "year", "'0000abcd-0000-0000-0000-' || lpad(CAST(doc_id // 2 AS VARCHAR), 12, '0')", "NULL", "'http://bd/card?id=0000abcd-0000-0000-0000-' || lpad(CAST(doc_id // 2 AS VARCHAR), 12, '0')", "NULL", "doc_id % 2 = 0"),
}


def expected(provider: str) -> str:
    title, people, date, sid, manifest, link, thumb, keep = EXPECTED[provider]
    return f"""SELECT '{provider}' AS provider_key, resp, CAST(row_number() OVER (PARTITION BY resp ORDER BY doc_id) - 1 AS INTEGER) AS hit_ix, {title} AS title, {people} AS creators, CAST({date} AS VARCHAR) AS date, {sid} AS source_id,
      CAST({manifest} AS VARCHAR) AS iiif_manifest, CAST({link} AS VARCHAR) AS item_url, CAST({thumb} AS VARCHAR) AS thumbnail_url FROM base WHERE resp % 20 <> 19 AND {keep}"""


@query("\nUNION ALL ".join(expected(p) for p in EXPECTED), BASE)
def json_records(spark, sf_dir):
    """Twelve JSON providers in their own shapes, read back as candidate records."""
    out = rec.all_json_records(responses(spark, sf_dir), "provider_key", "resp", "body")
    return out.withColumn("creators", F.array_join("creators", "|")).withColumn("hit_ix", F.col("hit_ix").cast("int"))


@query("SELECT resp, CAST(pos AS INTEGER) AS hit_ix, title, person || '|' || year AS creators, year AS date, CASE WHEN doc_id % 3 = 0 THEN 'h' || doc_id ELSE 'r' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS source_id, CASE WHEN doc_id % 3 < 2 THEN 'u' || doc_id END AS item_url FROM base", BASE)
def hathi_records(spark, sf_dir):
    """Records and items side by side; the first item id and the first item URL of each record are found apart."""
    name = F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    b = base(spark, sf_dir).select("resp", "doc_id", "year", "person", name.alias("rec"), "title")
    record = F.to_json(F.struct(F.array("title").alias("titles"), F.array("person", "year").alias("authors"), F.array("year").alias("publishDates")))
    items = F.concat_ws(
        ",",
        F.when(F.col("doc_id") % 3 < 2, F.to_json(F.struct(F.col("rec").alias("fromRecord"), F.concat(F.lit("u"), F.col("doc_id")).alias("itemURL")))),
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("rec").alias("fromRecord"), F.concat(F.lit("h"), F.col("doc_id")).alias("htid"), F.lit("late").alias("itemURL")))),
    )
    g = b.groupBy("resp").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.lit('"'), F.col("rec"), F.lit('":'), record).alias("r"), F.nullif(items, F.lit("")).alias("i")))).alias("l"))
    recs, its = F.array_join(F.transform("l", lambda x: x["r"]), ","), F.array_join(F.filter(F.transform("l", lambda x: x["i"]), lambda x: x.isNotNull()), ",")
    body = F.concat(F.lit('{"records":{'), recs, F.lit('},"items":['), its, F.lit("]}"))
    out = rec.hathi_records(g.select("resp", body.alias("body")), "resp", "body")
    return out.select("resp", F.col("hit_ix").cast("int").alias("hit_ix"), "title", F.array_join("creators", "|").alias("creators"), "date", "source_id", "item_url")


@query("SELECT doc_id, title, person AS creators, CASE WHEN doc_id % 2 = 0 THEN year END AS date, id AS source_id, CASE doc_id % 3 WHEN 0 THEN 'u' || id WHEN 1 THEN 'g' || id END AS item_url FROM base", BASE)
def record_normalize(spark, sf_dir):
    """Generic records: the first filled key of each kind counts."""
    shape = "to_json(struct(if(doc_id % 2 = 0, title, '') as title, title as name, person as creator, if(doc_id % 2 = 0, year, null) as issued, if(doc_id % 3 = 0, concat('u', id), '') as item_url, if(doc_id % 3 = 1, concat('g', id), null) as guid, id as identifier))"
    rows = base(spark, sf_dir).select("doc_id", F.try_parse_json(F.expr(shape)).alias("r"))
    f = rec.normalized(F.col("r"))
    return rows.select("doc_id", f["title"].alias("title"), F.array_join(f["creators"], "|").alias("creators"), f["date"].alias("date"), f["source_id"].alias("source_id"), f["item_url"].alias("item_url"))


XML = {
    "bnf_gallica": "<srw:record><srw:recordData><oai_dc:dc><dc:title>{t}</dc:title><dc:creator>{p}</dc:creator><dc:creator> {y} </dc:creator><dc:identifier>none</dc:identifier><dc:identifier>see https://gallica.bnf.fr/ark:/12148/{i}.texte</dc:identifier><dc:date>{y}</dc:date></oai_dc:dc></srw:recordData></srw:record>",
    "british_library": "<srw:record><srw:recordData><dc><dc:title>{t}</dc:title><dc:creator>{p}</dc:creator><dc:date>{y}</dc:date><dc:identifier>http://x/ark:/81055/{i}/manifest.json</dc:identifier></dc></srw:recordData></srw:record>",
    "e_rara": "<srw:record><srw:recordData><mods><titleInfo><title>{t}</title></titleInfo><subject><name><namePart>About</namePart></name></subject><name><namePart>{p}</namePart></name><originInfo><dateIssued>{y}</dateIssued></originInfo></mods></srw:recordData><srw:extraRecordData><vl:id>{i}</vl:id><vl:prefix>zut</vl:prefix></srw:extraRecordData></srw:record>",
    "sbb_digital": '<srw:record><srw:recordData><mods:mods><mods:titleInfo><mods:title>{t}</mods:title><mods:subTitle>sub</mods:subTitle></mods:titleInfo><mods:name><mods:namePart>part</mods:namePart><mods:displayForm>{p}</mods:displayForm></mods:name><mods:originInfo><mods:dateIssued>{y}</mods:dateIssued></mods:originInfo><mods:relatedItem><mods:recordInfo><mods:recordIdentifier>series</mods:recordIdentifier></mods:recordInfo></mods:relatedItem><mods:recordInfo><mods:recordIdentifier source="x">no</mods:recordIdentifier><mods:recordIdentifier source="gbv-ppn">{i}</mods:recordIdentifier></mods:recordInfo></mods:mods></srw:recordData></srw:record>',
}
SPACES = 'xmlns:srw="http://www.loc.gov/zing/srw/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:vl="http://visuallibrary.net/vl"'


#: Put before every title: what looks like a prefixed attribute is text here.
TEXT = "pct:x = 5, "


def sru(spark, sf_dir) -> DataFrame:
    """(provider_key, resp, body) of all SRU providers, from one scan of the documents."""

    def shown(shape: str):
        out = F.lit(shape)
        for key, value in (("t", F.concat(F.lit(TEXT), F.translate("title", "<>&\"'", "     "))), ("p", F.col("person")), ("y", F.col("year")), ("i", F.col("id"))):
            out = F.replace(out, F.lit("{" + key + "}"), value)
        return out

    each = F.array(*[F.struct(F.lit(p).alias("provider_key"), shown(shape).alias("x")) for p, shape in XML.items()])
    g = base(spark, sf_dir).select("resp", "doc_id", F.explode(each).alias("h")).select("h.*", "resp", "doc_id")
    g = g.groupBy("provider_key", "resp").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda x: x["x"]).alias("l"))
    body = F.concat(F.lit(f"<?xml version='1.0'?><srw:searchRetrieveResponse {SPACES}><srw:records>"), F.array_join("l", "\n"), F.lit("</srw:records></srw:searchRetrieveResponse>"))
    return g.select("provider_key", "resp", F.when(F.col("resp") % 20 == 19, F.concat(F.lit("<"), body)).otherwise(body).alias("body"))


CLEAN = "trim('pct:x = 5, ' || translate(title, '<>&\"''', '     '), ' ')"
SRU_EXPECTED = {
    "bnf_gallica": (CLEAN, "person || '|' || year", "id", "NULL", "'https://gallica.bnf.fr/ark:/12148/' || id"),
    "british_library": (CLEAN, "person", "id", "NULL", "NULL"),
    "e_rara": (CLEAN, "person", "id", "'https://www.e-rara.ch/i3f/v20/' || id || '/manifest'", "'https://www.e-rara.ch/zut/content/titleinfo/' || id"),
    "sbb_digital": (f"{CLEAN} || ' sub'", "person", "'PPN' || id", "NULL", "'https://digital.staatsbibliothek-berlin.de/werkansicht?PPN=PPN' || id"),
}


@query(
    "\nUNION ALL ".join(f"SELECT '{p}' AS provider_key, resp, CAST(pos AS INTEGER) AS hit_ix, {t} AS title, {c} AS creators, year AS date, {i} AS source_id, CAST({m} AS VARCHAR) AS iiif_manifest, CAST({u} AS VARCHAR) AS item_url FROM base WHERE resp % 20 <> 19" for p, (t, c, i, m, u) in SRU_EXPECTED.items()),
    BASE,
)
def sru_records(spark, sf_dir):
    """Four XML providers, Dublin Core and MODS, read back as candidate records."""
    out = rec.all_sru_records(sru(spark, sf_dir), "provider_key", "resp", "body")
    return out.select("provider_key", "resp", F.col("hit_ix").cast("int").alias("hit_ix"), "title", F.array_join("creators", "|").alias("creators"), "date", "source_id", "iiif_manifest", "item_url")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Display ' || c_custkey WHEN 1 THEN 'Part ' || c_custkey END AS creator FROM customer")
def mods_creator(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("<name><namePart>P</namePart><displayForm> Display "), k, F.lit("</displayForm></name>"))).when(k % 4 == 1, F.concat(F.lit("<name><displayForm> </displayForm><namePart>Part "), k, F.lit("</namePart></name>"))).otherwise("")
    xml = F.concat(F.lit('<mods xmlns="http://www.loc.gov/mods/v3"><subject><name><namePart>About</namePart></name></subject>'), name, F.lit("</mods>"))
    return table(spark, sf_dir, "customer").select("c_custkey", xml.alias("x")).select("c_custkey", rec.mods_creator(F.col("x")).alias("creator"))


@query(
    """SELECT k, kind, CAST(row_number() OVER (PARTITION BY k, kind ORDER BY g, f) AS INTEGER) AS ord, url FROM (
      SELECT c_custkey AS k, 'image' AS kind, g, f, 'https://m/' || c_custkey || '/' || u || '/' || f || '.jpg' AS url FROM customer, (VALUES (0, 'THUMBS'), (1, 'MAX'), (2, 'DEFAULT')) t(g, u), (VALUES (0), (1), (2)) s(f)
      WHERE CASE c_custkey % 3 WHEN 0 THEN u = 'MAX' WHEN 1 THEN u = 'DEFAULT' ELSE TRUE END
      UNION ALL SELECT c_custkey, 'pdf', 9, 0, 'https://m/' || c_custkey || '/all.pdf?a=1&b=2' FROM customer)"""
)
def mets_pick(spark, sf_dir):
    """The best file group that a METS document names; customers of the third kind name none, and all count."""
    k = F.col("c_custkey")
    groups = []
    for use in ("THUMBS", "MAX", "DEFAULT"):
        files = "".join(f'<mets:file MIMETYPE="image/jpeg"><mets:FLocat xlink:href="https://m/<k>/{use}/{f}.jpg"/></mets:file>' for f in range(3))
        named = F.when(k % 3 == 2, "X" + use).when((k % 3 == 1) & F.lit(use == "MAX"), "OTHER").otherwise(use.lower())
        groups.append(F.concat(F.lit('<mets:fileGrp USE="'), named, F.lit('">'), F.replace(F.lit(files), F.lit("<k>"), k.cast("string")), F.lit("</mets:fileGrp>")))
    pdf = F.replace(F.lit('<mets:fileGrp USE="DOWNLOAD"><mets:file MIMETYPE="application/pdf"><mets:FLocat xlink:href="https://m/<k>/all.pdf?a=1&amp;b=2"/></mets:file></mets:fileGrp>'), F.lit("<k>"), k.cast("string"))
    xml = F.concat(F.lit('<?xml version="1.0"?><mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:xlink="http://www.w3.org/1999/xlink"><mets:fileSec>'), *groups, pdf, F.lit("</mets:fileSec></mets:mets>"))
    return rec.mets_files(table(spark, sf_dir, "customer").select(k.alias("k"), xml.alias("body")), "k", "body").select("k", "kind", "ord", "url")


@query("SELECT page_id, count(*) AS n, min(href) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(rec.html_links(F.col("html"))).alias("a"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("a.href").alias("first_href"))


@query("SELECT page_id, 'bsb' || (page_id // 2) AS source_id, 'T' || page_id AS title FROM pages")
def viewer_links(spark, sf_dir):
    i = F.col("page_id")
    body = F.concat(F.lit('<p><a href="/en/view/bsb'), F.floor(i / 2), F.lit('?q=1"> T'), i, F.lit(' </a><a href="/view/bsb'), F.floor(i / 2), F.lit('">again</a><a href="/about">x</a>'))
    pages = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return rec.viewer_links(pages, "page_id", "body").select("page_id", "source_id", "title")


@query("SELECT page_id, md5(CAST(page_id AS VARCHAR)) AS digest, 1 AS ord FROM pages")
def digest_links(spark, sf_dir):
    d = F.md5(F.col("page_id").cast("string"))
    body = F.concat(F.lit('<tr><td><a href="/md5/'), F.upper(d), F.lit('?x">one</a><a href="/md5/'), d, F.lit('">two</a><a href="/md5/short">no</a>'))
    return rec.digest_links(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body").select("page_id", "digest", "ord")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey WHEN 1 THEN 'bi' || o_orderkey END AS resource, CASE o_orderkey % 2 WHEN 0 THEN o_orderkey || 'X' END AS ppn FROM orders")
def catalogue_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("https://datos.bne.es/resource/a"), k, F.lit("/"))).when(k % 4 == 1, F.concat(F.lit(" bi"), k)).when(k % 4 == 2, F.concat(F.lit("https://other.es/a"), k)).otherwise("no id")
    link = F.when(k % 2 == 0, F.concat(F.lit("https://digital.example.org/PPN"), k, F.lit("X/1")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), value.alias("v"), link.alias("l")).select("k", rec.catalogue_id(F.col("v")).alias("resource"), rec.ppn_of_url(F.col("l")).alias("ppn"))


ASKED = "asked AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'internet_archive' WHEN 1 THEN 'bnf_gallica' WHEN 2 THEN 'europeana' WHEN 3 THEN 'british_library' WHEN 4 THEN 'e_rara' ELSE 'mdz' END AS p, title || ' \"q\"' AS t, CASE WHEN doc_id % 4 > 0 THEN person END AS c FROM base)"
RAW, CQL = "replace(t, '\"', ' ')", "replace(replace(t, '\\', '\\\\'), '\"', '\\\"')"


@query(
    f"""SELECT doc_id, CASE p
      WHEN 'internet_archive' THEN 'title:("' || {RAW} || '")' || coalesce(' AND creator:("' || c || '")', '') || ' AND mediatype:(texts)'
      WHEN 'bnf_gallica' THEN 'gallica all "' || {CQL} || '"' || coalesce(' and dc.creator all "' || c || '"', '')
      WHEN 'europeana' THEN 'title:"' || {RAW} || '"' || coalesce(' AND who:"' || c || '"', '')
      WHEN 'british_library' THEN 'title all "' || {CQL} || '"' || coalesce(' and creator all "' || c || '"', '')
      WHEN 'e_rara' THEN '"' || {CQL} || '"' || coalesce(' and "' || c || '"', '')
      ELSE t || coalesce(' ' || c, '') END AS q FROM asked""",
    BASE, ASKED,
)
def search_dialects(spark, sf_dir):
    """Search texts in the providers' query dialects."""
    names = ["internet_archive", "bnf_gallica", "europeana", "british_library", "e_rara", "mdz"]
    d = F.col("doc_id")
    provider = F.element_at(F.array(*map(F.lit, names)), (d % 6 + 1).cast("int"))
    return base(spark, sf_dir).select("doc_id", dialects.search_text(provider, F.concat("title", F.lit(' "q"')), F.when(d % 4 > 0, F.col("person"))).alias("q"))

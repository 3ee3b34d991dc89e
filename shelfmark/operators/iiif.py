"""IIIF manifests (Presentation 2 and 3) as variant expressions: pages, metadata, renderings, image URLs.

A manifest is a JSON text; malformed parts become nulls and drop out, so one bad canvas
never loses the others.  Functions that list things return one row per thing with its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Preferred renderings, best first.
RENDERING_TYPES = ("application/pdf", "application/epub+zip")


def text_at(variant: Column, path: str) -> Column:
    """The string at a path; null where it is missing, empty or no string."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", F.nullif(F.try_variant_get(variant, path, "string"), F.lit("")))


def node(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def elements(df: DataFrame, source: Column, keep: list[str], item: str, pos: str) -> DataFrame:
    """One row for each element of a variant array, or the variant itself where it is an object."""
    kind = F.schema_of_variant(source)
    listed = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(source, "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), F.array(source))
    return df.select(*keep, F.posexplode(listed).alias(pos, item))


def _service_id(holder: Column, *keys: str) -> Column:
    """The first usable id among one or several service blocks."""
    found = []
    for key in keys:
        many = F.try_variant_get(holder, f"$.{key}", "array<variant>")
        ids = F.transform(many, lambda s: F.coalesce(text_at(s, "$['@id']"), text_at(s, "$.id")))
        found += [F.get(F.filter(ids, lambda x: x.isNotNull()), F.lit(0)), text_at(holder, f"$.{key}['@id']"), text_at(holder, f"$.{key}.id")]
    return F.coalesce(*found)


def _before_full(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("/full/")), F.substring_index(url, "/full/", 1))


def canvases(manifests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, version, seq, canvas, image, service): the primary image of each canvas and its image service."""
    base = manifests.select(key, F.try_parse_json(F.col(body)).alias("_m"))
    seqs = elements(base, node(F.col("_m"), "$.sequences"), [key], "_s", "seq")
    two = elements(seqs, node(F.col("_s"), "$.canvases"), [key, "seq"], "_c", "canvas")
    resource = node(F.col("_c"), "$.images[0].resource")
    choice = text_at(resource, "$['@type']") == "oa:Choice"
    chosen = F.when(choice, F.coalesce(node(resource, "$.default"), node(resource, "$.item[0]"), node(resource, "$.item"), resource)).otherwise(resource)
    two = two.select(key, F.lit(2).alias("version"), "seq", "canvas", chosen.alias("_r"))
    image = F.coalesce(text_at(F.col("_r"), "$['@id']"), text_at(F.col("_r"), "$.id"))
    two = two.select(key, "version", "seq", "canvas", image.alias("image"), F.coalesce(_service_id(F.col("_r"), "service"), _before_full(image)).alias("service"))

    three = elements(base, node(F.col("_m"), "$.items"), [key], "_c", "canvas")
    annotation = node(F.col("_c"), "$.items[0].items[0].body")
    first = F.coalesce(node(annotation, "$[0]"), annotation)
    chosen = F.when(text_at(first, "$.type") == "Choice", F.coalesce(node(first, "$.items[0]"), first)).otherwise(first)
    three = three.select(key, F.lit(3).alias("version"), F.lit(0).alias("seq"), "canvas", chosen.alias("_r"))
    image = text_at(F.col("_r"), "$.id")
    three = three.select(key, "version", "seq", "canvas", image.alias("image"), F.coalesce(_service_id(F.col("_r"), "service", "services"), _before_full(image)).alias("service"))
    return two.unionByName(three)


def _first_of_each(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Distinct values of each key, numbered from 1 by their first place."""
    once = Window.partitionBy(key, value).orderBy(*order)
    kept = rows.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


PLACE = ["version", "seq", "canvas"]


def page_sources(manifests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, kind, url, ord): one source per canvas, its image service if it has one, each URL once."""
    rows = canvases(manifests, key, body).withColumn("url", F.coalesce("service", "image")).withColumn("kind", F.when(F.col("service").isNotNull(), "service").otherwise("direct"))
    return _first_of_each(rows, key, "url", PLACE).select(key, "kind", "url", "ord")


def image_services(manifests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url, ord): the distinct image service bases."""
    return _first_of_each(canvases(manifests, key, body).withColumnRenamed("service", "url"), key, "url", PLACE).select(key, "url", "ord")


def direct_images(manifests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url, ord): the distinct whole-image URLs."""
    return _first_of_each(canvases(manifests, key, body).withColumnRenamed("image", "url"), key, "url", PLACE).select(key, "url", "ord")


def localized(variant: Column, path: str) -> Column:
    """The text at a path: a string, the first of a list, or the first value of a language map."""
    languages = F.map_values(F.try_variant_get(variant, path, "map<string,array<string>>"))
    listed = F.get(F.filter(languages, lambda v: F.size(v) > 0), F.lit(0))
    return F.coalesce(text_at(variant, path), text_at(variant, f"{path}[0]"), F.get(listed, F.lit(0)))


def manifest_metadata(manifests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, label, attribution, metadata): the manifest's names; of repeated metadata keys the last value stays."""
    m = F.try_parse_json(F.col(body))
    base = manifests.select(key, m.alias("_m"))
    label = localized(F.col("_m"), "$.label")
    attribution = F.coalesce(text_at(F.col("_m"), "$.attribution"), localized(F.col("_m"), "$.attribution.value"), text_at(F.col("_m"), "$.requiredStatement"), localized(F.col("_m"), "$.requiredStatement.value"))
    listed = F.try_variant_get(F.col("_m"), "$.metadata", "array<variant>")
    entries = F.transform(listed, lambda e: F.struct(F.coalesce(localized(e, "$.label"), F.lit("")).alias("k"), F.coalesce(localized(e, "$.value"), F.lit("")).alias("v")))
    entries = F.filter(entries, lambda e: e["k"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return base.select(key, label.alias("label"), attribution.alias("attribution"), F.map_from_entries(F.coalesce(last, F.expr("cast(array() as array<struct<k:string,v:string>>)"))).alias("metadata"))


def rendering_rank(url: Column, kind: Column, allowed: tuple[str, ...] = RENDERING_TYPES) -> Column:
    """Place of a rendering's type in the list; its suffix counts only where it declares no type; null if not allowed."""
    by_type = by_suffix = None
    for i, want in enumerate(allowed):
        hit = F.contains(kind, F.lit(want))
        by_type = F.when(hit, i) if by_type is None else by_type.when(hit, i)
    for suffix in ("pdf", "epub"):
        hit = F.endswith(F.lower(url), F.lit(f".{suffix}"))
        place = next((i for i, want in enumerate(allowed) if suffix in want), len(allowed))
        by_suffix = F.when(hit, place) if by_suffix is None else by_suffix.when(hit, place)
    if by_type is None:
        return F.lit(0)
    return F.when(F.contains(kind, F.lit("/")), by_type).otherwise(by_suffix)


def renderings(manifests: DataFrame, key: str, body: str, allowed: tuple[str, ...] = RENDERING_TYPES) -> DataFrame:
    """(key, url, format, label, rank, ord): allowed renderings of the manifest, then of its sequences, best type first."""
    base = manifests.select(key, F.try_parse_json(F.col(body)).alias("_m"))
    own = elements(base, node(F.col("_m"), "$.rendering"), [key], "_r", "pos").withColumn("seq", F.lit(-1))
    seqs = elements(base, node(F.col("_m"), "$.sequences"), [key], "_s", "seq")
    nested = elements(seqs, node(F.col("_s"), "$.rendering"), [key, "seq"], "_r", "pos")
    rows = own.select(key, "seq", "pos", "_r").unionByName(nested.select(key, "seq", "pos", "_r"))
    r = F.col("_r")
    kind = F.lower(F.coalesce(text_at(r, "$.format"), text_at(r, "$.format[0]"), text_at(r, "$.type"), F.lit("")))
    rows = rows.select(key, "seq", "pos", F.coalesce(text_at(r, "$['@id']"), text_at(r, "$.id")).alias("url"), kind.alias("format"), localized(r, "$.label").alias("label"))
    rows = rows.withColumn("rank", rendering_rank(F.col("url"), F.col("format"), allowed)).filter("rank is not null")
    once = Window.partitionBy(key, "url").orderBy("seq", "pos")
    kept = rows.filter("url is not null").withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("rank", "seq", "pos"))).select(key, "url", "format", "label", "rank", "ord")


def image_url_ladder(base: Column, info: Column | None = None) -> Column:
    """Image URLs to try for a service, in order; ``info`` is its info.json as a variant."""
    b = F.rtrim(base, F.lit("/"))

    def urls(*tails: str) -> list[Column]:
        return [F.concat(b, F.lit(f"/full/{t}")) for t in tails]

    common = urls("full/0/default.jpg", "max/0/default.jpg", "pct:100/0/default.jpg", "full/0/native.jpg", "full/0/color.jpg")
    if info is None:
        return F.array(*common)
    widths = F.transform(F.try_variant_get(info, "$.sizes", "array<variant>"), lambda s: F.try_variant_get(s, "$.width", "int"))
    widest = F.coalesce(F.array_max(widths), F.lit(0))
    limit = F.coalesce(F.try_variant_get(info, "$.maxWidth", "int"), F.lit(0))
    width = F.when((limit > 0) & (widest > 0), F.least(widest, limit)).when(limit > 0, limit).otherwise(widest)

    def sized(tail: str) -> Column:
        return F.concat(b, F.lit("/full/"), width.cast("string"), F.lit(f",/0/{tail}"))

    none = F.expr("cast(array() as array<string>)")
    first = F.when(width > 0, F.array(sized("default.jpg"), sized("native.jpg"))).otherwise(none)
    last = F.when(width > 0, none).otherwise(F.array(*urls("2000,/0/default.jpg", "1000,/0/default.jpg")))
    ladder = F.concat(first, F.array(*common), last)
    png = F.exists(F.coalesce(F.try_variant_get(info, "$.formats", "array<string>"), none), lambda f: F.lower(f) == "png")
    with_png = F.concat(F.transform(ladder, lambda u: F.regexp_replace(u, r"\.jpg$", ".png")), ladder)
    return F.array_distinct(F.when(info.isNull(), F.array(*common)).when(png, with_png).otherwise(ladder))


def with_image_info(services: DataFrame, base: str, infos: DataFrame, info_base: str, info_body: str) -> DataFrame:
    """Adds ``tries``, the URLs tried before a service's info.json is known, and ``urls``, its whole ladder once it is.

    ``infos`` are captured info.json documents by service; a service without one keeps the plain ladder.
    """
    bare = F.rtrim(F.col(info_base), F.lit("/"))
    dim = infos.groupBy(bare.alias("_b")).agg(F.min(info_body).alias("_j")).select("_b", F.try_parse_json("_j").alias("_info"))
    out = services.join(dim, F.rtrim(F.col(base), F.lit("/")) == F.col("_b"), "left")
    plain = image_url_ladder(F.col(base))
    return out.withColumn("tries", F.slice(plain, 1, 3)).withColumn("urls", F.when(F.col("_info").isNull(), plain).otherwise(image_url_ladder(F.col(base), F.col("_info")))).drop("_b", "_info")


def first_pages(pages: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` pages of each manifest, all where it is not positive."""
    return pages.filter(F.col("ord") <= most) if most and most > 0 else pages


def completeness(pages: DataFrame, key: str, saved: str) -> DataFrame:
    """(key, pages_expected, pages_downloaded, status) from planned pages with a saved flag."""
    counted = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages_expected"), F.count_if(F.col(saved)).alias("pages_downloaded"))
    status = F.when(F.col("pages_downloaded") == 0, "failed").when(F.col("pages_downloaded") < F.col("pages_expected"), "partial").otherwise("completed")
    return counted.withColumn("status", status)


def file_stem(template: str, entry_id: Column, name: Column, provider: Column, item: Column) -> Column:
    """The naming template filled in; an unknown placeholder or an empty result falls back to provider and item."""
    blank = F.lit("")
    values = {
        "entry_id": F.coalesce(entry_id, blank),
        "name": F.coalesce(name, blank),
        "provider": F.coalesce(F.nullif(provider, blank), F.lit("direct_iiif")),
        "item_id": F.coalesce(F.nullif(item, blank), F.lit("unknown")),
    }
    fallback = F.concat_ws("_", values["provider"], values["item_id"])
    left = template
    out = F.lit(template)
    for key, value in values.items():
        left = left.replace("{" + key + "}", "")
        out = F.replace(out, F.lit("{" + key + "}"), value)
    stem = fallback if "{" in left or "}" in left else out
    stem = F.trim(F.trim(stem), F.lit("_"))
    return F.when(stem == "", fallback).otherwise(stem)

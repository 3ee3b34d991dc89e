"""Downloads as events: gates, attempts, byte accounting, outcomes, and the sink that stores payloads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payload import extension_of_type, magic_problem, rejects_html, sniff_extension, target_folder
from .state import fold_sorted

# Attempts after a connection that was never made; texts by which such a failure is known.
CONNECT_ATTEMPTS = 2
CONNECT_FAILURES = ["newconnectionerror", "connecttimeouterror", "failed to establish a new connection", "connection refused", "actively refused", "network is unreachable", "no route to host"]
# Statuses that a work may end with, and those that a check may turn into ``partial``.
LIFECYCLE = ["pending", "completed", "partial", "failed", "deferred", "no_match"]


def attempt_cap(error: Column, most: Column) -> Column:
    """Attempts that a request may take: fewer where the connection was never made."""
    never = F.lit(False)
    for text in CONNECT_FAILURES:
        never = never | F.contains(F.lower(error), F.lit(text))
    return F.when(F.coalesce(never, F.lit(False)), F.least(most, F.lit(CONNECT_ATTEMPTS))).otherwise(most)


def attempts_made(attempts: DataFrame, request: str, order: str, outcome: str, error: str, most: int) -> DataFrame:
    """(request, attempts, outcome): the attempts that a retry loop makes of the recorded ones, and how it ends.

    The loop ends at the first outcome that is not ``retry``, or when the attempts so far
    reach the cap of the latest error.
    """
    n = F.row_number().over(Window.partitionBy(request).orderBy(order))
    rows = attempts.withColumn("_n", n)
    ends = (F.col(outcome) != "retry") | (F.col("_n") >= attempt_cap(F.col(error), F.lit(most)))
    last = rows.groupBy(request).agg(F.min(F.when(ends, F.struct("_n", outcome))).alias("_e"), F.max(F.struct("_n", outcome)).alias("_l"))
    end = F.coalesce("_e", "_l")
    return last.select(request, end["_n"].alias("attempts"), F.when(end[outcome] == "retry", "failure").otherwise(end[outcome]).alias("outcome"))


def quota_gate(tasks: DataFrame, view: DataFrame, limited: list[str]) -> DataFrame:
    """Adds ``gate``: ``go``, ``defer`` until ``reset_at``, or ``fallback`` where the provider's setting does not wait.

    ``view`` is a quota view with ``wait_for_reset`` (null waits).  Only limited providers are looked at.
    """
    dim = view.select(F.col("provider_key").alias("_p"), "exhausted", F.col("reset_at"), F.coalesce("wait_for_reset", F.lit(True)).alias("_wait"))
    out = tasks.join(dim, F.col("provider_key") == F.col("_p"), "left")
    spent = F.col("provider_key").isin(limited) & F.coalesce("exhausted", F.lit(False))
    gate = F.when(~spent, "go").when(F.col("_wait"), "defer").otherwise("fallback")
    return out.withColumn("gate", gate).withColumn("reset_at", F.when(F.col("gate") == "defer", F.col("reset_at"))).drop("_p", "exhausted", "_wait")


def quota_uses(downloads: DataFrame, limited: list[str]) -> DataFrame:
    """(provider_key, used): quota units of successful downloads; one that took another way than the counted one uses none."""
    counted = F.col("ok") & F.coalesce("fast_path", F.lit(True))
    return downloads.filter(F.col("provider_key").isin(limited)).groupBy("provider_key").agg(F.count_if(counted).alias("used"))


def fallback_outcomes(attempts: DataFrame, work: str) -> DataFrame:
    """(work, outcome, rank): what a download with fallbacks comes to.

    ``attempts``: rank (0 the selected record, then its fallbacks), ok, deferred (the quota
    was out).  The first success completes the work; without one it is deferred if the
    selected record's quota was out, else failed.
    """
    found = attempts.groupBy(work).agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("rank"), F.bool_or((F.col("rank") == 0) & F.col("deferred")).alias("_d"))
    return found.select(work, F.when(F.col("rank").isNotNull(), "completed").when(F.col("_d"), "deferred").otherwise("failed").alias("outcome"), "rank")


def lifecycle(events: DataFrame, work: str, order: list[str]) -> DataFrame:
    """(work, status): the last known status of each work; a failed check turns a completed work into a partial one."""
    known = events.filter(F.col("status").isin(*LIFECYCLE, "check_failed"))
    place = F.struct(*order)
    ended = known.groupBy(work).agg(F.max_by("status", F.when(F.col("status") != "check_failed", place)).alias("_s"), F.max(F.when(F.col("status") != "check_failed", place)).alias("_at"), F.max(F.when(F.col("status") == "check_failed", place)).alias("_c"))
    turned = F.col("_s").isin("completed", "partial") & (F.col("_c") > F.col("_at"))
    return ended.select(work, F.when(turned, "partial").otherwise(F.coalesce("_s", F.lit("pending"))).alias("status"))


def chunk_accounting(chunks: DataFrame, kind: str, order: str, file: str, size: str, discarded: str, limit: dict[str, int | None]) -> DataFrame:
    """Adds ``accepted`` and ``used``: bytes booked chunk by chunk against a kind's total.

    ``chunks`` of one file follow each other; ``discarded`` marks the last chunk of a file
    that is thrown away after it came.  A refused chunk ends its file, and what a refused or
    discarded file had booked is given back.
    """

    def step(state, what, name, n, gone):
        used, current, mine, dead = state
        if name != current:
            current, mine, dead = name, 0, False
        most = limit.get(what)
        ok = not dead and (most is None or used + n <= most)
        if ok:
            used, mine = used + n, mine + n
        if gone or not (ok or dead):
            used, mine = used - mine, 0
        return (used, current, mine, dead or not ok), ok, used

    return fold_sorted(chunks, kind, [order], [kind, file, size, discarded], lambda: (0, None, 0, False), step, "accepted boolean, used long")


def login_page(head: Column, url: Column, provider: Column, markers: list[str]) -> Column:
    """Is a payload of that library its login or error page, by one of the markers in its first 2,048 characters?"""
    own = F.contains(F.lower(url), F.lit("annas-archive")) | F.contains(F.lower(F.coalesce(provider, F.lit(""))), F.lit("annas-archive"))
    text = F.lower(F.left(F.decode(head, "UTF-8"), F.lit(2048)))
    return F.coalesce(own & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)), F.lit(False))


def decided(payloads: DataFrame, allowed: list[str], keep_others: bool = True) -> DataFrame:
    """Adds ``extension``, ``folder`` and ``problem`` to payloads (url, content_type, body): what is stored where, or why not."""
    head = F.substring("body", 1, 512)
    ext = F.coalesce(F.nullif(sniff_extension(head), F.lit("")), F.nullif(extension_of_type(F.col("content_type")), F.lit("")), F.lit(".bin"))
    out = payloads.withColumn("extension", ext)
    html = rejects_html(F.col("content_type"), F.col("url"), F.octet_length("body"))
    claimed = F.lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"(\.pdf|\.epub)$", 1))
    problem = F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty").when(html, "HTML instead of a document").otherwise(magic_problem(head, F.when(claimed != "", claimed).otherwise(F.col("extension"))))
    return out.withColumn("problem", problem).withColumn("folder", F.when(F.col("problem").isNull(), target_folder(F.col("extension"), allowed, keep_others)))


def store_payloads(payloads: DataFrame, root: str, work: str, name: str) -> DataFrame:
    """(work, path, bytes): writes each payload that has a ``folder`` to ``root/<work>/<folder>/<name>``.

    A file appears under its own name only when it is whole; a task that runs again writes
    the same bytes to the same place, so a lost executor does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", root))
        made: set[str] = set()
        for batch in batches:
            out = []
            for where, folder, file, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{base}/{where}/{folder}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                part = f"{place}/.{file}.{attempt}.part"
                with fs.open_output_stream(part, compression=None) as stream:
                    stream.write(body)
                if fs.get_file_info(f"{place}/{file}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{place}/{file}")
                fs.move(part, f"{place}/{file}")
                out.append((where, f"{where}/{folder}/{file}", len(body)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], ["work", "path", "bytes"])

    rows = payloads.filter("folder is not null").select(F.col(work).cast("string").alias("work"), "folder", F.col(name).alias("name"), F.col("body").cast("binary").alias("body"))
    return rows.mapInArrow(run, "work string, path string, bytes long")


def metadata_plan(documents: DataFrame, work: str, stem: str, slug: str, body: str, order: str, limit: int | None = None) -> DataFrame:
    """(work, order, filename, bytes): numbered names of the metadata documents that a work's budget admits, in order.

    The first document of a stem and provider has no number; a refused one takes none.
    """
    from .state import budget

    sized = documents.withColumns({"_bytes": F.octet_length(body).cast("long"), "_kind": F.lit("metadata")})
    kept = budget(sized, work, "_kind", "_bytes", order, {"metadata": limit}).filter("admitted")
    n = F.row_number().over(Window.partitionBy(work, stem, slug).orderBy(order))
    base = F.concat_ws("_", stem, slug)
    return kept.withColumn("_n", n).select(work, order, F.concat(F.when(F.col("_n") > 1, F.concat_ws("_", base, F.col("_n").cast("string"))).otherwise(base), F.lit(".json")).alias("filename"), F.col("_bytes").alias("bytes"))


def archive_files(metadata: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, url): the files of an Internet Archive item worth fetching, in the order to try them.

    PDF comes before EPUB before DjVu; derived text files never count.  The extension is the
    file's own, or, where it has none, what its format names.
    """
    files = metadata.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(F.col(body)), "$.files", "array<variant>")).alias("pos", "f"))
    at = lambda name: F.try_variant_get("f", f"$.{name}", "string")
    rows = files.select(key, "pos", F.trim(F.coalesce(F.nullif(at("name"), F.lit("")), at("file"))).alias("name"), F.lower(F.coalesce(at("format"), F.lit(""))).alias("format"), F.lower(F.coalesce(at("source"), F.lit(""))).alias("source"))
    rows = rows.filter((F.col("name") != "") & ~((F.col("source") == "derivative") & F.contains(F.lower("name"), F.lit("_text"))))
    ext = F.lower(F.regexp_extract("name", r"[^./](\.[^./]*)$", 1))
    rank = None
    for i, want in enumerate((".pdf", ".epub", ".djvu")):
        hit = (ext == want) | ((ext == "") & F.contains(F.col("format"), F.lit(want[1:])))
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    rows = rows.withColumn("_rank", rank).filter("_rank is not null")
    quoted = F.replace(F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    url = F.concat(F.lit("https://archive.org/download/"), F.col(key).cast("string"), F.lit("/"), quoted)
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_rank", "pos")).alias("place"), url.alias("url"))


def loc_image(items: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url): the one image of a Library of Congress item that stands for it, the last and largest of a list."""
    v = F.try_variant_get(F.try_parse_json(F.col(body)), "$.item.image_url", "variant")
    many = F.try_variant_get(v, "$", "array<variant>")
    one = F.coalesce(F.try_element_at(many, F.lit(-1)), v)
    kind = F.schema_of_variant(one)
    url = F.when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(F.try_variant_get(one, "$.medium", "string"), F.try_variant_get(one, "$.full", "string"))).when(kind == "STRING", F.try_variant_get(one, "$", "string"))
    url = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(~F.startswith(url, F.lit("http")), F.concat(F.lit("https://www.loc.gov"), url)).otherwise(url)
    return items.select(key, F.nullif(url, F.lit("")).alias("url"))


def digital_copies(ids: DataFrame, key: str, value: str, links: DataFrame) -> DataFrame:
    """(key, digital_id): the UUID of each id's digital copy: its own, or that of its catalogue record's first link.

    ``links``: resource, digital (captured see-also links), ord.
    """
    from ..sources.records import catalogue_id

    uuid = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"

    def of(text: Column) -> Column:
        return F.nullif(F.lower(F.regexp_extract(text, uuid, 1)), F.lit(""))

    first = links.groupBy(F.col("resource").alias("_r")).agg(F.min_by("digital", "ord").alias("_d"))
    out = ids.withColumn("_own", of(F.col(value))).withColumn("_res", F.when(F.col("_own").isNull(), catalogue_id(F.col(value))))
    return out.join(first, F.col("_res") == F.col("_r"), "left").select(key, F.coalesce("_own", of(F.col("_d"))).alias("digital_id"))


def source_links(records: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url, ppn): the first link in field 856, subfield u, of a source record, and the PPN in it."""
    from ..sources.records import ppn_of_url

    fields = F.try_variant_get(F.try_parse_json(F.col(body)), "$.856", "array<map<string,array<variant>>>")
    subfields = F.flatten(F.flatten(F.transform(fields, lambda f: F.map_values(f))))
    urls = F.filter(F.transform(subfields, lambda s: F.try_variant_get(s, "$.u", "string")), lambda u: F.coalesce(u, F.lit("")) != "")
    return records.select(key, F.get(urls, F.lit(0)).alias("url")).withColumn("ppn", ppn_of_url(F.col("url")))


def preview(manifests: DataFrame, url: str, body: str) -> DataFrame:
    """(url, provider_key, item_id, label, page_count, has_renderings, rendering_formats): what a manifest would bring."""
    from ..functions.ids import item_id, provider_of_url
    from .iiif import manifest_metadata, page_sources, renderings

    rows = manifests.select(F.col(url).alias("_url"), F.col(body).alias("_body"))
    base = rows.select(F.col("_url").alias("url"), provider_of_url(F.col("_url")).alias("provider_key"), item_id(F.col("_url")).alias("item_id"))
    label = manifest_metadata(rows, "_url", "_body").select(F.col("_url").alias("_u"), "label")
    pages = page_sources(rows, "_url", "_body").groupBy(F.col("_url").alias("_p")).agg(F.count(F.lit(1)).alias("page_count"))
    formats = renderings(rows, "_url", "_body").groupBy(F.col("_url").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "format"))), lambda x: x["format"]).alias("_f"))
    out = base.join(label, F.col("url") == F.col("_u"), "left").join(pages, F.col("url") == F.col("_p"), "left").join(formats, F.col("url") == F.col("_r"), "left")
    listed = F.filter(F.coalesce("_f", F.expr("cast(array() as array<string>)")), lambda f: f != "")
    return out.select("url", "provider_key", "item_id", "label", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.col("_f").isNotNull().alias("has_renderings"), listed.alias("rendering_formats"))

"""The state document of quotas and deferred items: one JSON object in a file, as tables and back."""

from __future__ import annotations

import contextlib
import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, scratch

# Fields of a quota record and of a deferred item, with what stands for a missing one.
QUOTA_FIELDS = {"provider_key": ("string", "unknown"), "daily_limit": ("int", 10), "reset_hours": ("int", 24), "downloads_used": ("int", 0), "period_start": ("string", None), "exhausted_at": ("string", None)}
ITEM_FIELDS = {
    "id": ("string", None), "title": ("string", "Unknown"), "creator": ("string", None), "entry_id": ("string", None), "provider_key": ("string", "unknown"), "provider_name": ("string", "Unknown"),
    "source_id": ("string", None), "work_dir": ("string", ""), "base_output_dir": ("string", "downloaded_works"), "item_url": ("string", None), "deferred_at": ("string", None), "reset_time": ("string", None),
    "retry_count": ("int", 0), "last_retry_at": ("string", None), "status": ("string", "pending"), "error_message": ("string", None),
}
VERSION = "1.0"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.getUri().getScheme() == "file":
        # a checksum beside a local file would forbid to edit it by hand
        fs = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        fs.initialize(jvm.java.net.URI.create("file:///"), conf)
    return fs, target


def _field(v: Column, name: str, kind: str, default) -> Column:
    """A record's field; an absent one takes the default, a null stays null, and a text that is no number is malformed."""
    there = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    return F.when(there, F.try_variant_get(v, f"$.{name}", kind)).otherwise(F.lit(default).cast(kind))


def _records(rows: DataFrame, v: Column, fields: dict[str, tuple]) -> DataFrame:
    """The records that are objects; one with a number field that holds none is passed over, the others stay."""
    v_ = F.col("_v")
    rows = rows.withColumn("_v", v).filter(F.startswith(F.schema_of_variant(v_), F.lit("OBJECT")))
    for name, (kind, _) in fields.items():
        if kind == "int":
            given = F.try_variant_get(v_, f"$.{name}", "variant")
            rows = rows.filter(given.isNull() | F.try_variant_get(v_, f"$.{name}", "int").isNotNull())
    raw = F.coalesce(F.to_json(F.try_variant_get(v_, "$.raw_data", "variant")), F.lit("{}"))
    return rows.select(*[c for c in rows.columns if c != "_v"], *[_field(v_, n, k, d).alias(n) for n, (k, d) in fields.items()], raw.alias("raw_data"))


def _quotas(objects: DataFrame) -> DataFrame:
    """The quota table of (at, _v): JSON objects of records.

    The key of a quota record counts over what the record itself says, the last of equal keys over the others.
    """
    entries = objects.select("at", F.explode(F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))).alias("e"))
    last = entries.groupBy(F.col("e.key").alias("_key")).agg(F.max_by(F.col("e.value"), "at").alias("_q"))
    return _records(last, F.col("_q"), QUOTA_FIELDS).withColumn("provider_key", F.col("_key")).select(*QUOTA_FIELDS)


def _items(arrays: DataFrame) -> DataFrame:
    """The item table of (at, _v): JSON arrays of records; ``ord`` rises with the place in the file."""
    listed = arrays.select("at", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_n", "_i"))
    items = _records(listed.select((F.col("at") + F.col("_n")).alias("ord"), "_i"), F.col("_i"), ITEM_FIELDS)
    return items.withColumn("id", F.coalesce("id", F.uuid())).select("ord", *ITEM_FIELDS, "raw_data")


#: Up to the next bracket outside strings, and up to the end of a string.
BRACKET = re.compile(rb'[^"{}\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{}\[\]]*+)*+[{}\[\]]', re.S)
STRING_END = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """(block, size, value): a file's text in pieces that end before each ``}``, read in parallel blocks."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _runs(batches):
    """(block, size, text) of the pieces, each with its ``}``, in order."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                yield int(block[a]), batch.column(1)[a].as_py(), b"}".join(batch.column(2).slice(a, b - a).to_pylist()) + b"}"


def _after(text: bytes, inside: bool, depth: int) -> tuple[bool, int]:
    """Whether the text ends inside a string, and at which depth."""
    pos = 0
    if inside:
        if not (m := STRING_END.match(text)):
            return True, depth
        pos = m.end()
    while m := BRACKET.match(text, pos):
        pos = m.end()
        depth += 1 if text[pos - 1] in b"{[" else -1
    # the text ends with a bracket, so only a string is left open
    return pos < len(text), depth


def _ends(batches):
    """(block, size, length, in0, depth0, in1, depth1): how each block ends if it begins outside or inside a string."""
    found: dict[int, list] = {}
    for block, size, text in _runs(batches):
        b = found.setdefault(block, [size, 0, (False, 0), (True, 0)])
        b[1:] = b[1] + len(text), _after(text, *b[2]), _after(text, *b[3])
    rows = [(k, size, n, *out, *inside) for k, (size, n, out, inside) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.bool_() if i in (3, 5) else pa.int64()) for i in range(7)], names=["block", "size", "length", "in0", "depth0", "in1", "depth1"])


PIECES = "at long, section boolean, begins boolean, ends boolean, first boolean, last boolean, text binary"


def _pieces(starts: dict[int, tuple[int, bool, int]]):
    """Cuts blocks, whose place, string state and depth at their start are given, into ``PIECES``.

    A section is what a top-level bracket holds.  It is cut behind each record, so a piece is a comma and some values of
    which only the last is no plain one.  A piece that crosses blocks comes in parts.  What is in no section comes as it
    is; ``ends`` then tells that a section follows.
    """

    def run(batches):
        state: dict[int, list] = {}
        for block, _, text in _runs(batches):
            if state and block not in state:
                yield from left(state)
            at, inside, depth = starts[block]
            at, inside, depth, begins, first, held = state.pop(block, (at, inside, depth, depth < 2, False, b""))
            rows, start, pos, text = [], 0, len(held), held + text
            opened = not inside
            if inside and (m := STRING_END.match(text, pos)):
                pos, opened = m.end(), True
            while opened and (m := BRACKET.match(text, pos)):
                pos = m.end()
                if text[pos - 1] in b"{[":
                    depth += 1
                    if depth == 2:
                        rows.append((at + start, False, True, True, False, False, text[start:pos]))
                        start, begins, first = pos, True, True
                else:
                    depth -= 1
                    if depth == 2:
                        rows.append((at + start, True, begins, True, first, False, text[start:pos]))
                        start, begins, first = pos, True, False
                    elif depth == 1:
                        rows.append((at + start, True, begins, True, first, True, text[start : pos - 1]))
                        start, begins, first = pos - 1, True, False
            state[block] = [at + start, pos < len(text), depth, begins, first, text[start:]]
            yield from batch(rows)
        yield from left(state)

    def left(state):
        for at, _, depth, begins, first, held in state.values():
            if depth >= 2 or held:
                yield from batch([(at, depth >= 2, begins, False, first, False, held)])
        state.clear()

    def batch(rows):
        kinds = [pa.int64(), *[pa.bool_()] * 5, pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["at", "section", "begins", "ends", "first", "last", "text"])

    return run


def read_state(spark: SparkSession, path: str, listed: str = "deferred_items") -> tuple[DataFrame, DataFrame] | None:
    """(quotas, items) of a state document in a file, of whatever size and layout; none where it holds no JSON object.

    The text is never held whole.  One pass finds how each block of it ends, a second cuts it behind each record.  Equal
    keys of the whole object count by the last; a section of the wrong kind is empty, a malformed record is passed over.
    """
    blocks = sorted(_cut(spark, path).mapInArrow(_ends, "block long, size long, length long, in0 boolean, depth0 long, in1 boolean, depth1 long").collect())
    at, inside, depth, starts = 0, False, 0, {}
    for b in blocks:
        starts[b.block] = (at, inside, depth)
        at, inside, depth = at + b.length, b.in1 if inside else b.in0, depth + (b.depth1 if inside else b.depth0)
    # a text that does not end with } got one
    added = at - blocks[0].size if blocks else -1
    if added not in (0, 1) or inside or depth != -added:
        return None
    pieces = kept(_cut(spark, path).mapInArrow(_pieces(starts), PIECES), "state-pieces")
    bare, sections = b"", []
    for r in pieces.filter("not section").orderBy("at").toLocalIterator():
        if sections and sections[-1][1] is None:
            sections[-1][1] = r.at
        bare += r.text
        if r.ends:
            keyed = bare.endswith(b"{")
            bare += b'"":%d' % len(sections) if keyed else b"%d" % len(sections)
            sections.append([r.at + len(r.text), None, keyed])
    try:
        root = json.loads(bare[: len(bare) - added].decode())
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    parts = pieces.filter("section")
    crossing = parts.filter("not (begins and ends)")
    places = sorted((r.at, not r.begins) for r in crossing.select("at", "begins").collect())
    whole = []
    for place, inner in places:
        whole.append((place, not inner, whole[-1][2] if inner else place))
    joined = crossing.join(F.broadcast(spark.createDataFrame(whole, "at long, begins boolean, whole long")), ["at", "begins"]).groupBy("whole").agg(
        F.max("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("at", (~F.col("begins")).alias("i"), "text"))).alias("all")
    )
    joined = joined.select(F.col("whole").alias("at"), "first", "last", F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text"))
    units = parts.filter("begins and ends").select("at", "first", "last", "text").unionByName(joined).withColumn("text", F.trim(F.col("text").cast("string"), F.lit(" \t\r\n")))
    body = F.when(F.col("first"), F.col("text")).when(F.startswith("text", F.lit(",")), F.trim(F.substr("text", F.lit(2)), F.lit(" \t\r\n")))
    units = units.filter("text != '' or not last").select("at", body.alias("text"))

    def read(keyed: bool, rows: DataFrame) -> DataFrame:
        ends = "{}" if keyed else "[]"
        return rows.select("at", F.when(F.col("text") != "", F.try_parse_json(F.concat(F.lit(ends[0]), "text", F.lit(ends[1])))).alias("_v"))

    def of(section) -> DataFrame:
        return read(section[2], units.filter(F.col("at").between(section[0], section[1])))

    for section in sections:
        if not of(section).filter("_v is null").isEmpty():
            return None

    def chosen(name: str, keyed: bool) -> DataFrame:
        value = root.get(name)
        if isinstance(value, dict if keyed else list) and value:
            return of(sections[value[""] if keyed else value[0]])
        return read(keyed, units.filter(F.lit(False)))

    return _quotas(chosen("quotas", True)), _items(chosen(listed if listed in root else "deferred_items", False))


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    kinds = lambda fields: ", ".join(f"{n} {k}" for n, (k, _) in fields.items())
    return spark.createDataFrame([], kinds(QUOTA_FIELDS)), spark.createDataFrame([], f"ord long, {kinds(ITEM_FIELDS)}, raw_data string")


@contextlib.contextmanager
def _replacing(spark: SparkSession, path: str):
    """A stream to a name beside ``path``, which takes its place once all is written."""
    fs, target = _fs(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        yield out
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not write {path}")


def _append(spark: SparkSession, folder: str, out) -> None:
    """Moves a folder of text lines that begin with a comma into a stream, without the first comma."""
    fs, target = _fs(spark, folder)
    io, first = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, True
    parts = [f.getPath() for f in fs.listStatus(target) if f.getPath().getName().startswith("part-") and f.getLen()]
    for p in sorted(parts, key=lambda p: int(p.getName().split("-")[1])):
        source = fs.open(p)
        if first:
            source.read()
        io.copyBytes(source, out, 1 << 20, False)
        source.close()
        fs.delete(p, False)
        first = False


def write_state(spark: SparkSession, path: str, quotas: DataFrame, items: DataFrame, order: str, now: Column) -> None:
    """Writes the state document of all quotas and items, a record a line; its text passes by the driver as a stream.

    Of quotas with one key the greatest record counts.
    """
    none, folder = {"ignoreNullFields": "false"}, scratch(spark, "state-lines")
    q = quotas.groupBy("provider_key").agg(F.max(F.struct(*QUOTA_FIELDS)).alias("q")).orderBy("provider_key").select(F.to_json(F.create_map("provider_key", "q"), none).alias("j"))
    q.select(F.concat(F.lit(","), F.substr("j", F.lit(2), F.length("j") - 2)).alias("value")).write.text(f"{folder}/quotas")
    rows = items.orderBy(order, *ITEM_FIELDS, "raw_data").select(F.to_json(F.struct(*ITEM_FIELDS), none).alias("j"), F.coalesce("raw_data", F.lit("{}")).alias("raw"))
    rows.select(F.concat(F.lit(","), F.left("j", F.length("j") - 1), F.lit(',"raw_data":'), "raw", F.lit("}")).alias("value")).write.text(f"{folder}/items")
    stamp = spark.range(1).select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    with _replacing(spark, path) as out:
        out.write(bytearray(f'{{"version":"{VERSION}","last_updated":"{stamp}","quotas":{{\n'.encode()))
        _append(spark, f"{folder}/quotas", out)
        out.write(bytearray(b'},"deferred_items":[\n'))
        _append(spark, f"{folder}/items", out)
        out.write(bytearray(b"]}"))


def save_state(spark: SparkSession, path: str, document: str) -> None:
    """Writes a state document given as a text."""
    with _replacing(spark, path) as out:
        out.write(bytearray(document.encode()))


def load_state(spark: SparkSession, path: str, legacy: tuple[str, str] | None = None) -> tuple[str, DataFrame, DataFrame]:
    """(how, quotas, items) of the state file: ``loaded``, ``corrupt``, ``migrated`` or ``fresh``.

    A file that holds no JSON object is copied beside itself with the ending ``.corrupt`` and
    counts as empty.  Only where there is no file are the two ``legacy`` files (quotas, queue)
    taken over.  A file that cannot be read is an error, so that nothing writes over it.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        found = read_state(spark, path)
        if found is None:
            jvm = spark.sparkContext._jvm
            copy = jvm.org.apache.hadoop.fs.Path((path.rpartition(".")[0] if "." in path.rpartition("/")[2] else path) + ".corrupt")
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, copy, False, spark.sparkContext._jsc.hadoopConfiguration())
            return ("corrupt", *empty_state(spark))
        return ("loaded", *found)
    old = [p for p in legacy or () if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if not old:
        return ("fresh", *empty_state(spark))
    # the old queue's list has another name
    quotas, items = zip(*(read_state(spark, p, "items") or empty_state(spark) for p in old), strict=True)
    return "migrated", functools.reduce(DataFrame.unionByName, quotas), functools.reduce(DataFrame.unionByName, items)

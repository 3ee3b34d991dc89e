"""Checks of stored works: payload folders against the index, per-work verdicts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import magic_problem
from ..functions.text import strip

# Statuses of index rows that are checked, and of folders that are not.
EXPECTED = ["completed", "partial", ""]
UNDOWNLOADED = ["no_match", "failed", "deferred"]


def _location(uri: str):
    return pafs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", uri))


def work_folders(spark: SparkSession, root: str) -> DataFrame:
    """(work_dir, document): the work folders right under ``root``, those with an ``objects`` folder or a ``work.json``.

    One executor lists the root and streams the names on; others look into the folders.
    ``document`` is the text of the work.json, null where there is none.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _location(uri)
                found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
                held = [f"{uri.rstrip('/')}/{f.base_name}" for f in found if f.type == pafs.FileType.Directory]
                for i in range(0, len(held), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(held[i : i + 10_000], pa.string())], ["work_dir"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str | None]] = []
            for uri in batch.column(0).to_pylist():
                fs, path = _location(uri)
                objects, work = fs.get_file_info([f"{path}/objects", f"{path}/work.json"])
                if work.type == pafs.FileType.File:
                    with fs.open_input_stream(work.path, compression=None) as stream:
                        out.append((uri, stream.read().decode("utf-8", "replace")))
                elif objects.type == pafs.FileType.Directory:
                    out.append((uri, None))
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["work_dir", "document"])

    listed = spark.createDataFrame([(root,)], "work_dir string").mapInArrow(names, "work_dir string")
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(look, "work_dir string, document string")


def stored_files(folders: DataFrame, head: int = 512) -> DataFrame:
    """(work_dir, name, length, head): files under each folder's ``objects``, unfinished ones left out.

    Executors list the folders and read only the first bytes of each file; empty files count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int, bytes]] = []
            for folder in batch.column(0).to_pylist():
                fs, path = _location(folder)
                for f in fs.get_file_info(pafs.FileSelector(f"{path}/objects", allow_not_found=True)):
                    if f.type == pafs.FileType.File and not f.base_name.endswith(".part"):
                        with fs.open_input_stream(f.path, compression=None) as stream:
                            out.append((folder, f.base_name, f.size, stream.read(head)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["work_dir", "name", "length", "head"])

    return folders.select("work_dir").mapInArrow(run, "work_dir string, name string, length long, head binary")


def normal_path(path: Column, windows: bool = False) -> Column:
    """A path in one spelling, so that index and folder rows meet; case and backslashes fold on Windows alone."""
    if windows:
        path = F.lower(F.translate(path, "\\", "/"))
    scheme = F.regexp_extract(path, "^[A-Za-z][A-Za-z0-9+.-]*://", 0)
    rest = F.regexp_replace(F.substr(path, F.length(scheme) + 1), "/(?:\\./|/)*", "/")
    return F.concat(scheme, F.when(rest == "/", rest).otherwise(F.rtrim(rest, F.lit("/"))))


def works_to_verify(index: DataFrame, folders: DataFrame, windows: bool = False) -> DataFrame:
    """(path, status, origin): index rows of expected statuses, and the other folders whose work was downloaded.

    ``path`` is as the index, or else the folder, spells it; of several spellings the first in order.
    """

    def side(rows: DataFrame, keep) -> DataFrame:
        s = F.lower(strip(F.coalesce("status", F.lit(""))))
        keyed = rows.select(normal_path(F.col("work_dir"), windows).alias("_key"), F.col("work_dir").alias("p"), s.alias("s")).filter("_key is not null")
        return keyed.filter(keep(F.col("s"))).groupBy("_key").agg(F.min("p").alias("path"), F.max("s").alias("status"))

    listed, found = side(index, lambda s: s.isin(EXPECTED)), side(folders, lambda s: ~s.isin(UNDOWNLOADED))
    rest = found.join(listed.select("_key"), "_key", "left_anti")
    return listed.withColumn("origin", F.lit("index")).unionByName(rest.withColumn("origin", F.lit("folder"))).drop("_key")


def verdicts(works: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, ok, reason): the first thing that is wrong with each work.

    ``works``: key, pages_expected (null if unknown); ``files``: key, name, length, head.
    """
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    found = files.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("length") == 0).alias("empty"),
        F.min_by(magic_problem(F.col("head"), ext), F.when(magic_problem(F.col("head"), ext).isNotNull(), F.col("name"))).alias("wrong"),
    )
    out = works.join(found, key, "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no objects")
        .when(F.col("empty") > 0, "empty file")
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(F.col("pages_expected") > F.col("n"), "missing pages")
    )
    return out.select(key, reason.isNull().alias("ok"), reason.alias("reason"))


def verify(spark: SparkSession, root: str, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(checked, changes) of all works under ``root`` and in the index.

    ``checked``: path, ok, reason.  ``changes``: path, status ``partial`` and, where the work
    has a readable work.json, its new text, for every work that is not whole.  Works that
    were never downloaded are left out.
    """
    from .audit import changed_status

    found = work_folders(spark, root).withColumn("status", F.get_json_object("document", "$.status"))
    listed = index if index is not None else spark.createDataFrame([], "work_dir string, status string")
    works = works_to_verify(listed.select("work_dir", "status"), found.select("work_dir", "status"))
    said = found.select(F.col("work_dir").alias("path"), "document")
    works = works.join(said, "path", "left").withColumn("pages_expected", F.get_json_object("document", "$.pages_expected").try_cast("int"))
    files = stored_files(works.select(F.col("path").alias("work_dir"))).withColumnRenamed("work_dir", "path")
    checked = verdicts(works, files, "path")
    bad = works.join(checked.filter(~F.col("ok")).select("path"), "path").select("path", F.lit("partial").alias("status"), "document")
    return checked, changed_status(bad, F.lit("partial"), F.current_timestamp())


def verdict_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("partial"))

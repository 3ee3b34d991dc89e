"""The works CSV and the index CSV as all-text tables, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import INDEX_COLUMNS

#: Separators, quotes and line ends as spreadsheets write them; nothing is inferred.
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "inferSchema": "false", "enforceSchema": "false", "emptyValue": "", "nullValue": "\x00"}


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text, as written: ``00123`` keeps its zeros; a byte order mark in the first header goes."""
    df = spark.read.options(**CSV).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])


def read_works(spark: SparkSession, path: str, link_column: str = "direct_link") -> DataFrame:
    """The works table, with a file order in ``_row_ix``.

    Raises ValueError where entry_id, or both the title and the link column, are missing;
    ``retrievable`` and ``link`` are added where missing, unknown columns stay.
    """
    df = read_csv_text(spark, path)
    names = set(df.columns)
    if "entry_id" not in names:
        raise ValueError("the works table has no entry_id column")
    if not names & {"short_title", link_column}:
        raise ValueError(f"the works table has neither a short_title nor a {link_column} column")
    for c in ("short_title", "main_author", "direct_link", "retrievable", "link"):
        if c not in names:
            df = df.withColumn(c, F.lit(None).cast("string"))
    # one split reads a multi-line file, so the generated ids follow the lines
    return df.withColumn("_row_ix", F.monotonically_increasing_id())


def year_column(df: DataFrame) -> Column:
    """The cell of the column called ``year`` in any case, null where there is none."""
    name = next((c for c in df.columns if c.strip().lower() == "year"), None)
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def line_end(spark: SparkSession, path: str) -> str:
    """The line end of a text file's first line, which alone is read, however long it is."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    return "\r\n" if first and first.value.endswith("\r") else "\n"


def write_csv(df: DataFrame, path: str, line_sep: str = "\n", one_file: bool = False) -> None:
    """Writes a table as CSV; the committer replaces the folder only when all parts are there."""
    out = df.drop("_row_ix")
    out = out.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in out.columns])
    if one_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(header="true", quote='"', escape='"', lineSep=line_sep, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def backup(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Copies a works file or folder beside itself, once a run before its first change; null where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, copy = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.backup_{stamp}")
    fs = source.getFileSystem(conf)
    if not fs.exists(source):
        return None
    if not fs.exists(copy):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, copy, False, conf)
    return copy.toString()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index ledger, all text, with its fixed columns first and ``_row_ix``."""
    df = read_csv_text(spark, path)
    for c in INDEX_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select(*INDEX_COLUMNS, *[c for c in df.columns if c not in INDEX_COLUMNS]).withColumn("_row_ix", F.monotonically_increasing_id())


def query_frame(spark: SparkSession, title: str, creator: str | None = None) -> DataFrame:
    """A works table of one ad-hoc query."""
    schema = StructType([StructField(c, StringType()) for c in ("entry_id", "short_title", "main_author", "direct_link", "retrievable", "link")])
    return spark.createDataFrame([("E0001", title, creator, None, None, None)], schema)


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rows): the CSV files of a folder with the number of their rows; a quoted line break ends no row."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.csv").load(folder).select("path")
    # the header is a record like any other here, so files without rows are seen too
    records = spark.read.options(**CSV | {"header": "false", "recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}).schema("first string, rest string").csv(folder)
    counted = records.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(counted, "path", "left").select("path", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("rows"))

"""Line deduplication in DataFrame functions only.

Lines are exploded once, reduced to two 64-bit hashes of their normalised key and written,
narrow, to the work folder.  One aggregation finds each line's rows, its largest document
and a set of 64 document buckets, so a line that a third of all documents hold is one row of
every task before anything is shuffled.  As many buckets as documents wanted prove a line
frequent; the documents of the few other repeated lines are counted one by one.  Lines then
look their keeper up: very frequent ones in a broadcast of bounded size, the others in a
shuffle.  Each text is shuffled at most once, and only to meet its own drops.

Defined cases: a null or empty text is one empty line; a text whose lines all go becomes
the empty text; rows that share doc_id and text are treated alike and all stay; rows that
share a doc_id count as one document; a row without doc_id keeps all its lines and counts
for no line; a line of any length is one line.  Other columns are passed through or
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, stored, workspace

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of documents that a line's set has.
DOC_BUCKETS = 64


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _row_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row_key, drops): positions of the lines that each row loses; rows that lose none are absent."""
    path = workspace(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id", _row_key(F.col("text")).alias("row_key"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
        .select("doc_id", "row_key", "pos", F.trim(F.col("line"), F.lit(BLANKS)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    lines = stored(lines, f"{path}/lines")
    bucket = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {DOC_BUCKETS}) as int))")
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"), F.bit_count(F.bit_or(bucket)).alias("buckets"))
    repeated = stored(repeated.filter(F.col("n") >= min_docs), f"{path}/repeated")
    sure, open_ = repeated.filter(F.col("buckets") >= min_docs), repeated.filter(F.col("buckets") < min_docs)
    counted = lines.join(open_.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "doc_id").distinct()
    counted = counted.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("h1", "h2")
    frequent = sure.unionByName(open_.join(counted, ["h1", "h2"], "left_semi")).select("h1", "h2", "n", "keeper")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    found = lookup(lines, frequent, ["h1", "h2"], total, F.xxhash64("doc_id", "pos"), "inner")
    return found.filter(F.col("doc_id") != F.col("keeper")).groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row, kept_text, n_lines, n_dropped): every input row as struct ``row`` with its remaining text.

    A line's key is the line without blanks at its ends and with A-Z lower-cased.  Keys of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all
    their lines except in the largest doc_id that holds them.
    """
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "drops")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(F.col(f"row.{id_col}").alias("doc_id"), _row_key(text).alias("row_key"), "row")
    lines = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda i: F.get(lines, i))
    return rows.join(drops, (F.col("doc_id") == F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").select(
        "doc_id",
        "row",
        F.when(F.col("drops").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; ``length_col`` follows if the table has it."""
    out = dedup_lines(docs, id_col, text_col, **limits)

    def column(c: str) -> Column:
        if c == text_col:
            return F.when(F.col(f"row.`{c}`").isNotNull(), F.col("kept_text")).alias(c)
        if c == length_col and length_col in docs.columns:
            return F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])

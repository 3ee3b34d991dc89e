"""Shared plumbing: the shared work folder, Arrow batch helpers, small numeric solvers."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows in one Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 512
#: Keys that are broadcast because each holds a large share of all rows; fewer than this.
HOT_KEYS = 4096
#: Narrow rows in one file of a stored table.
ROWS_PER_FILE = 200_000
#: Characters that a vectorised step handles at once.
CHUNK_CHARS = 1 << 19


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; any other session is an
    error, since a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not (root := sc.getCheckpointDir()):
            root = os.path.join(tempfile.gettempdir(), "checkpoints", "shelfmark")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared root, deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/shelfmark/{what}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder under ``workspace`` that no table reads any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: the lineage ends at files all executors share.

    ``rows``, about how many narrow rows there are, keeps small tables in few files.
    """
    out = df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    with small_batches(df.sparkSession):
        out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs inside sends Python at most ``rows`` rows at once; the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def in_small_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` that shows ``run`` at most ``rows`` rows at a time.

    Spark bounds the bytes of a batch; the session's settings stay as they are.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(i, rows) for batch in batches for i in range(0, max(batch.num_rows, 1), rows))

    return df.mapInArrow(sliced, schema)


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, spread: Column, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a key and in ``n`` the number of rows that hold it.

    Keys that hold over 1 / ``HOT_KEYS`` of ``total`` rows, so fewer than ``HOT_KEYS`` of
    them, are broadcast; all other rows meet their key in a shuffle in which no key is
    large.  There the rows of hot keys and those with a null key are dealt by ``spread``, a
    hash of the row.
    """
    named = [c for c in facts.columns if c not in keys and c != "n"]
    most = max(total // HOT_KEYS, 1)

    def side(part: DataFrame, mark: str) -> DataFrame:
        return part.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], F.struct(F.lit(True).alias("_"), *named).alias(f"{mark}found"))

    hot, rest = side(facts.filter(F.col("n") > most), "_h"), side(facts.filter(F.col("n") <= most), "_r")
    same = functools.reduce(Column.__and__, [F.col(k) == F.col(f"_h{k}") for k in keys])
    out = rows.join(F.broadcast(hot), same, "left")
    known = F.col("_hfound").isNotNull()
    for k in keys:
        known = known | F.col(k).isNull()
    # a row that is to meet nothing has a null key, which matches none, and a deal that places it
    out = out.withColumn("_deal", F.when(known, spread).otherwise(F.lit(0).cast("long"))).withColumns({f"_k{k}": F.when(~known, F.col(k)) for k in keys})
    rest = rest.withColumn("_rdeal", F.lit(0).cast("long"))
    same = F.col("_deal") == F.col("_rdeal")
    for k in keys:
        same = same & (F.col(f"_k{k}") == F.col(f"_r{k}"))
    out = out.join(rest, same, "left").withColumn("_found", F.coalesce("_hfound", "_rfound"))
    if how == "inner":
        out = out.filter("_found is not null")
    return out.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in named])


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def code_points(text: str) -> np.ndarray:
    """A text's code points as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_chunks(texts: Iterable[str], overlap: int, limit: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, str]]:
    """Runs of texts as (document numbers of each character, joined characters).

    Short texts are joined until ``limit``; a longer text is cut into chunks that repeat
    ``overlap`` characters, so no n-gram of ``overlap`` + 1 characters is lost or doubled.
    """
    docs: list[int] = []
    parts: list[str] = []
    held = 0

    def out():
        return np.repeat(np.array(docs, np.int64), [len(p) for p in parts]), "".join(parts)

    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - overlap, 1), limit):
            part = text[start : start + limit + overlap]
            if parts and held + len(part) > limit:
                yield out()
                docs, parts, held = [], [], 0
            docs.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield out()


def sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (1-d or rows) for each of ``n`` owners; ``owners`` ascends."""
    out = np.zeros((n, *values.shape[1:]), np.float64)
    if len(owners):
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        out[owners[starts]] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


class SparseRows:
    """Rows of (feature, value) pairs in one flat layout."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray], width: int):
        sizes = np.array([len(x) for x in index], np.int64)
        self.n, self.width = len(index), width
        self.index = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.value = np.concatenate(value).astype(np.float64) if value else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: SparseRows, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by L-BFGS; returns weights and intercept."""
    total = weight.sum()

    def loss(theta):
        z = x.times(theta[:-1]) + theta[-1]
        g = weight * (sigmoid(z) - y) / total
        f = (weight * (np.logaddexp(0, z) - y * z)).sum() / total + 0.5 * ridge * (theta[:-1] ** 2).sum()
        return f, np.r_[x.transposed_times(g) + ridge * theta[:-1], g.sum()]

    theta = np.zeros(x.width + 1)
    f, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, d, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        else:
            q *= 1.0 / max(np.linalg.norm(g), 1e-12)
        for (s, d, r), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - r * (d @ q))
        slope, t = g @ q, 1.0
        if slope <= 0:
            q, slope, past = g, g @ g, []
        while True:
            new = theta - t * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * t * slope or t < 1e-8:
                break
            t *= 0.5
        s, d = new - theta, g2 - g
        done = abs(f - f2) <= 1e-9 * max(1.0, abs(f))
        theta, f, g = new, f2, g2
        if s @ d > 1e-12:
            past = [*past[-7:], (s, d, 1.0 / (s @ d))]
        if done or np.linalg.norm(g) < 1e-7:
            break
    return theta[:-1], float(theta[-1])


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into calibrated probabilities (Newton steps)."""
    if len(z) == 0 or len(set(y.tolist())) < 2:
        return 1.0, 0.0
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, high, low)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        r, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum(), r.sum()]) + np.array([1e-3 * (a - 1), 0])
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)

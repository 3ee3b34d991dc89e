"""Quality rules: word statistics and a calibrated logistic regression on hashed n-grams.

Hashed word one- and two-grams and character three-grams, as shares of a text's n-grams,
feed a ridge logistic regression trained on a bounded sample of labelled rows; a held-out
part of the sample calibrates its scores into probabilities under the label shares of the
whole table.  Texts are scored in Arrow batches against fixed thresholds.

Defined cases: a null or empty text has no words and fails the base rules; without rows of
both labels the verdict is the base rules' alone; labels without a text, or texts without
a label, train nothing; repeated rows get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SparseRows, char_chunks, code_points, fit_logistic, fit_platt, in_small_batches, sigmoid, sums, utf8

WORD_BUCKETS = CHAR_BUCKETS = 1 << 16
#: Labelled rows that the model is trained on, for each label value at most.
SAMPLE_PER_LABEL = 1500
#: A text is kept from this calibrated probability of good quality on.
LEAST_PROBABILITY = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes of text that are worked on at once (a longer text alone).
GROUP_BYTES = 2 << 20


@dataclass
class QualityModel:
    """``weights`` of words, then characters; ``slope`` and ``shift`` calibrate; constant if there was nothing to learn."""

    weights: np.ndarray | None
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


class WordBatch:
    """The words of some texts, as numbers that equal words share, and their hashes."""

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.ids = np.fromiter((seen[w] for ws in words for w in ws), np.int64, int(self.counts.sum()))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen))
        seen.default_factory = None  # else the table holds itself and waits for the cycle collector

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owners, buckets) of single words, then of pairs inside a text."""
        h = self.hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint32)
        yield self.owner, (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
        pair = self.owner[1:] == self.owner[:-1]
        yield self.owner[1:][pair], ((h[:-1] * np.uint32(0x85EBCA77) + h[1:] * np.uint32(0xC2B2AE3D))[pair]) >> np.uint32(16)

    def repeated(self, size: int = WINDOW) -> np.ndarray:
        """For each text, the words inside windows of ``size`` words that occur twice or more in it."""
        n, out = len(self.ids), np.zeros(len(self.counts), np.int64)
        if n < size:
            return out
        m = n - size + 1
        x = self.ids.astype(np.uint64)
        h = self.owner[:m].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for k in range(size):
            h = (h ^ (x[k : k + m] * _MIX[k])) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(self.owner[:m] == self.owner[size - 1 :])
        at = at[np.argsort(h[at], kind="stable")]
        same = h[at[1:]] == h[at[:-1]]
        if not same.any():
            return out
        # candidates by hash are compared word by word; a clash of hashes sends its texts the plain way
        a, b = at[:-1][same], at[1:][same]
        equal = self.owner[a] == self.owner[b]
        for k in range(size):
            equal &= self.ids[a + k] == self.ids[b + k]
        marked = np.zeros(n + 1, np.int64)
        for side in (a[equal], b[equal]):
            hit = np.zeros(n + 1, bool)
            hit[side] = True
            marked[: n + 1] |= hit
        cover = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(marked)
        np.add.at(cover, starts, 1)
        np.add.at(cover, np.minimum(starts + size, n), -1)
        inside = np.cumsum(cover[:n]) > 0
        out = np.bincount(self.owner[inside], minlength=len(self.counts)).astype(np.int64)
        for doc in np.unique(np.r_[self.owner[a[~equal]], self.owner[b[~equal]]]):
            ids = self.ids[self.owner == doc].tolist()
            places = defaultdict(list)
            for i in range(len(ids) - size + 1):
                places[tuple(ids[i : i + size])].append(i)
            out[doc] = len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(size)})
        return out


def base_counts(texts: list[bytes], words: WordBatch | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each UTF-8 text."""
    words = words or WordBatch(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[ends[1:]] - total[ends[:-1]]

    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": words.counts,
        "word_chars": count(((raw & 0xC0) != 0x80) & ~_BLANK[raw]),
        "n_symbols": count(_SYMBOL[raw]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": words.repeated(),
    }


def _char_grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for owners, text in char_chunks((t.decode("utf-8", "replace") for t in texts), 2):
        cp = code_points(text)
        if len(cp) > 2:
            h = cp[:-2] * np.uint32(0x9E3779B1) + cp[1:-1] * np.uint32(0x85EBCA77) + cp[2:] * np.uint32(0xC2B2AE3D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
            good = owners[:-2] == owners[2:]
            yield owners[:-2][good], h[good] >> np.uint32(16)


def vectors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, shares) of each text: words and characters weigh one each in sum."""
    for t in texts:
        index, value = [], []
        for base, grams in ((0, WordBatch([t]).grams()), (WORD_BUCKETS, _char_grams([t]))):
            n = np.zeros(WORD_BUCKETS)
            for _, b in grams:
                n += np.bincount(b, minlength=WORD_BUCKETS)
            at = np.flatnonzero(n)
            index.append(at + base)
            value.append(n[at] / max(n.sum(), 1))
        yield np.concatenate(index), np.concatenate(value)


def raw_scores(model: QualityModel, texts: list[bytes], words: WordBatch) -> np.ndarray:
    """The regression's uncalibrated score of each text."""
    total = np.full(len(texts), model.intercept)
    for base, grams in ((0, words.grams()), (WORD_BUCKETS, _char_grams(texts))):
        s, n = np.zeros(len(texts)), np.zeros(len(texts))
        for own, bucket in grams:
            s += sums(model.weights[base + bucket], own, len(texts))
            n += np.bincount(own, minlength=len(texts))
        total += s / np.maximum(n, 1)
    return total


def probabilities(model: QualityModel, texts: list[bytes], words: WordBatch) -> np.ndarray:
    if model.weights is None:
        return np.ones(len(texts))
    return sigmoid(model.slope * raw_scores(model, texts, words) + model.shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Trains on the ``sample`` labelled ids of each label with the smallest hashes; a quarter of them calibrates.

    Of several texts of an id the one with the smallest hash counts, so the driver holds at
    most twice ``sample`` rows of features.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        return QualityModel(None)
    known = known.distinct()
    parts = [known.filter(F.col("y") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(vectors(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["doc_id", "index", "value"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    # the sample has at most twice ``sample`` rows of three numbers; each of its ids gives one text, however often it stands in ``docs``
    wanted = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = {r["doc_id"]: r for r in in_small_batches(wanted.select("doc_id", "text"), run, "doc_id long, index binary, value binary").toArrow().to_pylist()}
    rows = [found[r["doc_id"]] | r.asDict() for r in chosen.collect() if r["doc_id"] in found]
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["y"], r["index"]))
    y = np.array([r["y"] for r in rows], float)
    late = np.array([r["h"] >> 3 & 3 == 0 for r in rows], bool)
    if len(set(y[~late].tolist())) < 2:
        return QualityModel(None)

    def part(which: np.ndarray) -> SparseRows:
        own = [r for r, w in zip(rows, which, strict=True) if w]
        return SparseRows([np.frombuffer(r["index"], np.int32).astype(np.int64) for r in own], [np.frombuffer(r["value"], np.float32) for r in own], WORD_BUCKETS + CHAR_BUCKETS)

    balance = np.where(y[~late] == 1, 1.0 / max(y[~late].sum(), 1), 1.0 / max((1 - y[~late]).sum(), 1))
    w, b = fit_logistic(part(~late), y[~late], balance, ridge=1e-6)
    # calibration under the label shares of the whole table
    rate = {k: n / max(1, (y == k).sum()) for k, n in shares.items()}
    weight = np.array([rate[int(v)] for v in y[late]])
    slope, shift = fit_platt(part(late).times(w) + b, y[late], weight / max(weight.mean(), 1e-12) if len(weight) else weight)
    return QualityModel(w.astype(np.float32), b, slope, shift)


def _groups(texts: list[bytes]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > GROUP_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def assess(model: QualityModel, texts: list[bytes], least: float = LEAST_PROBABILITY) -> dict[str, np.ndarray]:
    """The counts, ``base_failed``, the calibrated probability and the verdict of each text."""
    parts = []
    for g in _groups(texts):
        words = WordBatch(texts[g])
        found = base_counts(texts[g], words)
        found["base_failed"] = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
        found["p_quality"] = probabilities(model, texts[g], words)
        found["kept"] = ~found["base_failed"] & (found["p_quality"] >= least)
        parts.append(found)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_PROBABILITY) -> DataFrame:
    """Counts, probability and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = assess(shared.value, utf8(batch.column(1)), least)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    return in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def with_good_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(assess(shared.value, utf8(batch.column(at)), least)["kept"]))

    return in_small_batches(docs, run, docs.schema)

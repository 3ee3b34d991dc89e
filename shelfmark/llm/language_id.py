"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a blank, and n-grams of one
to three characters are hashed into one table.  Executors count the n-grams of a bounded
sample of labelled rows; the smoothed log-probability matrix (buckets by languages) is
broadcast, and Arrow batches are scored by gathering its rows and summing them for each
document.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row every text is ``und``; a tie goes to the first language in sorted order; rows
without doc_id are predicted but never learned from; repeated rows get equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import char_chunks, code_points, in_small_batches, strings, sums

BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
#: Expected number of rows that each language is learned from.
SAMPLE_PER_LANGUAGE = 4000
#: Labels that a model may have; at 2^17 buckets they fill 64 MB.
MOST_LANGUAGES = 128
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


@dataclass
class LanguageModel:
    """Languages, their log priors, and log probabilities (buckets by languages)."""

    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray


def letter_table() -> np.ndarray:
    """One flag for each code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
    return _letters


def ngram_buckets(owners: np.ndarray, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, buckets) of every n-gram that has a letter and lies in one document, order by order.

    ``owners`` numbers the document of each character.
    """
    cp = code_points(text)
    letter = letter_table()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    blank = ~letter
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            return
        h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        good = owners[:m] == owners[n - 1 :]
        for k in range(n):
            h = (h ^ cp[k : k + m]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        # two blanks in a row say nothing about a language
        good &= letter[:m] if n == 1 else ~(blank[: m] & blank[1 : m + 1]) if n == 2 else letter[1 : m + 1]
        yield owners[:m][good], (h[good] >> np.uint32(3)) & np.uint32(BUCKETS - 1)


def _lower(text: str) -> str:
    return text.lower()


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
    return char_chunks((_lower(t) for t in texts), 0)


def held_out(doc_id: Column) -> Column:
    """Is the row in the held-out quarter?  Rows without doc_id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Learns from rows outside the held-out quarter, about ``sample`` of each language.

    The sample is by a hash of doc_id; it bounds the driver's and the counting work alike.
    Raises ValueError beyond ``most_languages`` labels, as the matrix grows with them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = dict(sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()))
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages; the model holds {BUCKETS} numbers for each of them")
    if not counts:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, -(-sample * scale // n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(scale)) < share[F.col("lang")])
    languages = list(counts)
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([at[x] for x in batch.column(1).to_pylist()], np.int64)
            for owners, text in chunks(strings(batch.column(0))):
                for own, bucket in ngram_buckets(owners, text):
                    total += np.bincount(label[own] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    found = in_small_batches(chosen.select("text", "lang"), count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((BUCKETS, len(languages)))
    total[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    smooth = total + 0.1
    prior = np.log(np.array(list(counts.values()), float) / sum(counts.values()))
    return LanguageModel(languages, prior, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text."""
    n, width = len(texts), len(model.languages)
    total, lettered = np.zeros((n, width)), np.zeros(n, bool)
    for owners, text in chunks(texts):
        for own, bucket in ngram_buckets(owners, text):
            lettered[own] = True
            if width:
                total += sums(model.logp[bucket], own, n)
    known = lettered & (width > 0)
    if not width:
        return [UNKNOWN] * n, np.zeros(n)
    total += model.prior
    best = total.argmax(axis=1)
    top = np.exp(-np.log(np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)))
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, top, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, p = score(shared.value, strings(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_known_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language of the model, by a posterior of ``least`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, p = score(shared.value, strings(batch.column(at)))
            yield batch.filter(pa.array((np.array(lang, object) != UNKNOWN) & (p >= least)))

    return in_small_batches(docs, run, docs.schema)

"""Sequence packing by power-of-two decomposition.

Each document's token ids are cut into pieces of binary length, the longest first: pieces
of ``max_tokens`` while they fit, then one piece for each bit of the rest.  A piece is a
sequence of its own, equal lengths form a bucket, so no sequence crosses documents and
none needs padding.  Sequence ids are dealt inside each input partition from a range of
its own, so numbering needs no shuffle.  A lost task that reads files gives the same ids
again; behind a shuffle the order of rows, and so the ids, may differ between attempts, so
write such an input first where ids have to last.

Ids are those of the ``tokenizers`` file.  Plain texts go through the same vocabulary's
rank file, which gives equal ids several times faster; texts with rarer characters or with
very long runs without blanks go through ``tokenizers`` itself.  Tests compare the two on
every pair of admitted characters and on runs around the longest one.

Defined cases: a null or empty text is the single closing id; repeated rows are packed
each; special-token strings in a text are ordinary text; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, strings

MAX_TOKENS, CLOSING_ID = 2048, 1
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"
#: Sequence ids of one input partition.
RANGE_BITS = 40
#: Bytes, and then characters, on which every engine's patterns agree: ASCII, Latin, Greek, Cyrillic, dashes and quotes.
_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127)])
_PLAIN_CHARS = re.compile("[¡-ʯͰ-ͳΈ-ϿЀ-ԯ‐-‧]*")
#: Longest run of bytes without blanks for the fast path, whose merges are quadratic in a run.
_LONGEST_RUN = 400


def pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` tokens; ``most`` is a power of two."""
    out = [(k * most, most) for k in range(n // most)]
    start, rest = n - n % most, n % most
    for bit in range(most.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


class Encoder:
    """Token ids of texts, equal to those of the ``tokenizers`` file."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))
        self.exact.encode_special_tokens = True
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace")
        rare = raw.translate(None, _PLAIN_BYTES).decode()
        if _PLAIN_CHARS.fullmatch(rare) and max(map(len, raw.split()), default=0) < _LONGEST_RUN:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, closing_id: int = CLOSING_ID, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids.

    ``ids`` holds little-endian unsigned 32-bit ids, ``bucket`` the power of two, ``offset``
    is 0 as a sequence holds one piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = Encoder(vocabulary, ranks), TaskContext.get().partitionId() << RANGE_BITS
        for batch in batches:
            where, rows = [], []
            for at, text in enumerate(strings(batch.column(1))):
                ids = np.append(encode(text), np.uint32(closing_id)).astype("<u4")
                for start, length in pieces(len(ids), max_tokens):
                    raw = ids[start : start + length].tobytes()
                    where.append(at)
                    rows.append((start, length, zlib.crc32(raw), len(ids), number, 0, length.bit_length() - 1, raw))
                    number += 1
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"])

    return in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences, one folder for each length."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)

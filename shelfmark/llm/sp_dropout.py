"""SentencePiece BPE with seeded merge-dropout, and its lossless decoder.

Symbols start as characters (bytes where the model has no such character) and merge by the
model's scores, best first, leftmost first among equals.  A candidate merge is taken off the
agenda unused when a hash of the seed, the document, its position and its two pieces falls
below the dropout share; so a document's segmentation is fixed by its key, and other keys
or seeds give other segmentations of the same text.  Pieces never join a blank to what
stands before it, so the runs between blanks are independent; all runs of a chunk take
their next merge in one vectorised step.

Decoding joins the pieces' bytes and drops the blank that encoding put first; every text
comes back exactly, also with literal U+2581 marks, which are encoded as bytes.

Defined cases: a null or empty text has no ids and decodes to the empty text; lone
surrogates count as question marks; a null doc_id is keyed like the text "None"; repeated
rows get equal ids; dropout 0 is the model's own segmentation.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, in_small_batches, strings

VOCABULARY, DROPOUT, SEED = "piece_bpe_32k.model", 0.1, 17
MARK = "▁"
#: Characters merged in one go; a longer text is cut between runs.
CHUNK = 1 << 19
#: Symbols of a run from which on it is merged by a heap of its own; shorter runs merge side by side.
LONG_RUN = 512
_NONE = np.iinfo(np.int32).max
#: Slots of the quick pair table, as a power of two.
TABLE_BITS = 19
_WORD = 2**64 - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class MergeModel:
    """A SentencePiece BPE vocabulary as arrays."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        size = sp.get_piece_size()
        plain = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece joins a blank to the text before it")
        self.size = size
        ranked = sorted(plain.items(), key=lambda x: (-sp.get_score(x[1]), x[1]))
        rank = {i: r for r, (_, i) in enumerate(ranked)}
        pairs = [(plain[p[:k]] * size + plain[p[k:]], rank[i], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        pairs.sort()
        self.pair = np.array([p for p, _, _ in pairs], np.int64)
        self.rank = np.array([r for _, r, _ in pairs], np.int32)
        self.merged = np.array([i for _, _, i in pairs], np.int32)
        # places of pairs by hash; of pairs with one hash the last is found here, the others by bisection
        self.quick = np.full(1 << TABLE_BITS, -1, np.int32)
        slot = self._slot(self.pair)
        self.quick[slot] = np.arange(len(self.pair))
        self.crowded = np.bincount(slot, minlength=len(self.quick)) > 1
        self.place_of = {int(p): at for at, p in enumerate(self.pair)}
        self.merges = np.zeros(size, bool)
        self.merges[self.pair // size] = True
        self.merges[self.pair % size] = True
        # the id of each character, -1 where the model has none
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1 and p != MARK:
                self.char_id[ord(p)] = i
        self.char_id[32] = self.mark = plain[MARK]

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return (pair * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(64 - TABLE_BITS) & np.int64((1 << TABLE_BITS) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, places): the given pairs that merge, and their places in the merge table."""
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        at = self.quick[slot]
        good = self.pair[at] == key
        good &= at >= 0
        hard = np.flatnonzero(~good & self.crowded[slot])
        if len(hard):
            found = np.minimum(np.searchsorted(self.pair, key[hard]), len(self.pair) - 1)
            hit = self.pair[found] == key[hard]
            at[hard[hit]], good[hard[hit]] = found[hit], True
        good = np.flatnonzero(good)
        return good, at[good]


def document_key(seed: int, doc_id) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{doc_id}")


def _symbols(model: MergeModel, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, character places): characters, and bytes where the model lacks a character."""
    ids = model.char_id[cp].astype(np.int64)
    lacking = np.flatnonzero(ids < 0)
    if not len(lacking):
        return ids, np.arange(len(cp))
    one = lacking[cp[lacking] < 128]
    ids[one] = model.byte_id[cp[one]]
    rest = np.flatnonzero(ids < 0)
    if not len(rest):
        return ids, np.arange(len(cp))
    raw = [chr(c).encode("utf-8", "replace") for c in cp[rest]]
    size = np.ones(len(cp), np.int64)
    size[rest] = [len(r) for r in raw]
    place = np.repeat(np.arange(len(cp)), size)
    out = ids[place]
    out[out < 0] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, place


def _skips(key: int, place: int, left: int, right: int, limit: int) -> bool:
    """The keyed hash of one candidate, as the vectorised step has it."""
    h = key ^ (place * int(_C[0]) & _WORD) ^ (left * int(_C[1]) & _WORD) ^ (right * int(_C[2]) & _WORD)
    h ^= h >> 32
    h = h * int(_C[3]) & _WORD
    h ^= h >> 29
    h = h * int(_C[0]) & _WORD
    return h ^ (h >> 32) < limit


def _agenda(model: MergeModel, sym: list[int], key: int, place: list[int], limit: int) -> list[int]:
    """The final id at each place of one run (-1 where merged away), by a heap of candidates."""
    after, before = [*range(1, len(sym)), -1], list(range(-1, len(sym) - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        if i < 0 or after[i] < 0:
            return
        left, right = sym[i], sym[after[i]]
        at = model.place_of.get(left * model.size + right)
        if at is not None and not (limit and _skips(key, place[i], left, right, limit)):
            heapq.heappush(heap, (int(model.rank[at]), i, left, right, int(model.merged[at])))

    for i in range(len(sym)):
        push(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue
        sym[i], sym[j], after[i] = new, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(before[i])
        push(i)
    return sym


def segment(model: MergeModel, ids: np.ndarray, starts: np.ndarray, key: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    """The final id at each symbol's place, -1 where a symbol went into the one before it.

    Runs begin where ``starts`` is set and merge by themselves; ``key`` and ``place`` give
    each symbol's document key and character place.
    """
    n = len(ids)
    out = np.full(n, -1, np.int64)
    limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))

    def ranks(sym: np.ndarray, nxt: np.ndarray, k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good, at = model.lookup(sym, nxt)
        r, m = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
        if dropout > 0 and len(good):
            h = k[good] ^ (p[good].astype(np.uint64) * _C[0]) ^ (sym[good].astype(np.uint64) * _C[1]) ^ (nxt[good].astype(np.uint64) * _C[2])
            h ^= h >> np.uint64(32)
            h *= _C[3]
            h ^= h >> np.uint64(29)
            h *= _C[0]
            h ^= h >> np.uint64(32)
            kept = h >= limit
            good, at = good[kept], at[kept]
        r[good], m[good] = model.rank[at], model.merged[at]
        return r, m

    # a symbol that merges with nothing ends its run
    alone = ~model.merges[ids]
    starts = starts | alone
    starts[1:] |= alone[:-1]
    begin = np.flatnonzero(starts)
    size = np.diff(np.r_[begin, n])
    for a, b in zip(begin[size > LONG_RUN], (begin + size)[size > LONG_RUN], strict=True):
        out[a:b] = _agenda(model, ids[a:b].tolist(), int(key[a]), place[a:b].tolist(), int(limit) if dropout > 0 else 0)
    short = np.repeat(size <= LONG_RUN, size)
    slot = np.flatnonzero(short).astype(np.int32)
    sym, first = ids[slot].astype(np.int32), starts[slot]
    rank, merged = np.full(len(sym), _NONE, np.int32), np.full(len(sym), -1, np.int32)
    inner = np.flatnonzero(~first[1:]) if len(sym) else np.zeros(0, np.int64)
    rank[inner], merged[inner] = ranks(sym[inner], sym[inner + 1], key[slot[inner]], place[slot[inner]])
    while len(sym):
        begin = np.flatnonzero(first)
        # the best rank of each run, and the leftmost place that has it
        low = np.minimum.reduceat(rank, begin)
        size = np.diff(np.r_[begin, len(sym)])
        alive = low < _NONE
        hit = np.flatnonzero(rank == np.repeat(np.where(alive, low, -1), size))
        run = np.searchsorted(begin, hit, "right")
        at = hit[np.r_[True, run[1:] != run[:-1]]] if len(hit) else hit
        sym[at] = merged[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        if not alive.all():
            # runs without a merge are done
            over = ~np.repeat(alive, size)
            out[slot[over]] = sym[over]
            stay &= ~over
        at = np.cumsum(stay)[at] - 1  # where the merged symbols go
        sym, slot, first, rank, merged = sym[stay], slot[stay], first[stay], rank[stay], merged[stay]
        if not len(sym):
            break
        # only the pairs on both sides of a merged symbol have changed
        last = np.r_[first[1:], True]
        changed = np.r_[at, (at - 1)[~first[at]]]
        ends = last[changed]
        rank[changed[ends]], merged[changed[ends]] = _NONE, -1
        c = changed[~ends]
        rank[c], merged[c] = ranks(sym[c], sym[c + 1], key[slot[c]], place[slot[c]])
    return out


def _chunks(model: MergeModel, texts: list[str]) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Lists of (text number, code points, offset) of about CHUNK characters, cut where runs begin."""
    held: list[tuple[int, np.ndarray, int]] = []
    total = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        cp = code_points((" " + text).encode("utf-8", "replace").decode())
        cuts = np.zeros(0, np.int64)
        if len(cp) > CHUNK:
            cuts = np.flatnonzero((cp[1:] == 32) & (cp[:-1] != 32)) + 1
        start = 0
        while start < len(cp):
            end = len(cp)
            if end - start > CHUNK and len(cuts):
                # the last run that begins inside the chunk, else the first beyond it
                near, beyond = cuts[(cuts > start) & (cuts <= start + CHUNK)], cuts[cuts > start + CHUNK]
                end = int(near[-1]) if len(near) else int(beyond[0]) if len(beyond) else len(cp)
            if held and total + end - start > CHUNK:
                yield held
                held, total = [], 0
            held.append((i, cp[start:end], start))
            total += end - start
            start = end
    if held:
        yield held


def encode(model: MergeModel, texts: list[str], keys: list[int], dropout: float = DROPOUT) -> list[np.ndarray]:
    """The ids of each text under its key."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for held in _chunks(model, texts):
        sizes = np.array([len(c) for _, c, _ in held])
        first = np.cumsum(sizes) - sizes
        cp = np.concatenate([c for _, c, _ in held])
        ids, char = _symbols(model, cp)
        begin = np.zeros(len(cp), bool)
        begin[1:] = (cp[1:] == 32) & (cp[:-1] != 32)
        begin[first] = True
        starts = begin[char] & np.r_[True, char[1:] != char[:-1]]
        part = np.repeat(np.arange(len(held)), sizes)[char]
        key = np.array([keys[i] for i, _, _ in held], np.uint64)[part]
        offset = np.array([o for _, _, o in held], np.int64) - first
        final = segment(model, ids, starts, key, char + offset[part], dropout)
        edges = np.searchsorted(part, np.arange(len(held) + 1))
        for (i, _, _), a, b in zip(held, edges[:-1], edges[1:], strict=True):
            found[i].append(final[a:b][final[a:b] >= 0])
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def decode(model: MergeModel, ids: np.ndarray) -> bytes:
    """The UTF-8 text of the ids."""
    return b"".join(map(model.bytes_of.__getitem__, ids.tolist()))[1:]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, text_crc32, lossless) of every row.

    ``ids`` are little-endian unsigned 32-bit numbers; ``lossless`` says that they decode to
    the very text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel(vocabulary)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            found = encode(model, texts, [document_key(seed, d) for d in names], dropout)
            raw = [x.astype("<u4").tobytes() for x in found]
            plain = [t.encode("utf-8", "replace") for t in texts]
            same = [decode(model, x) == t for x, t in zip(found, plain, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(raw, pa.binary()), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(map(zlib.crc32, plain), pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids", "ids_crc32", "text_crc32", "lossless"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows, run, "doc_id long, n_ids long, ids binary, ids_crc32 long, text_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel(vocabulary)
        for batch in batches:
            texts = [decode(model, np.frombuffer(x or b"", "<u4").astype(np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_small_batches(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")

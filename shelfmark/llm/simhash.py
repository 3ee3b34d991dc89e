"""SimHash near-duplicates with pigeonring filtering and distributed components.

A fingerprint is 64 bits; two fingerprints link when at most 3 bits differ.  The 64 bits are
a ring of four 16-bit segments.  If all four differ by at most 3 bits in sum, some segment
starts a chain whose running sums stay within their proportional budgets, 0, 1, 2 and 3
bits over one, two, three and four segments.  Candidates therefore agree in the chain's
first segment and, as at most one bit of the second differs, in one half of the second:
eight 24-bit keys a fingerprint.  Pairs of a key then pass the chain's budgets segment by
segment before the full distance is known.

Equal fingerprints are one class before any pair is looked at, keys held by many classes
are dealt out as pairs of bounded blocks, and a block pair yields a spanning forest, at
most one edge a member, never its pairs.  Components come from alternating star
contractions over written tables; nothing that grows with the corpus reaches the driver.
Rows meet their class, their key or their hub in a lookup that broadcasts only the few very
frequent ones, so none is met by one task.

Defined cases: a text that is null or holds no word has fingerprint 0 and links like any
other; one or two words form one shingle; repeated rows get equal results; a row without
doc_id gets its fingerprint and the component of its class, null if no row of the class
has a doc_id, and such a class links nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, in_small_batches, lookup, stored, utf8, workspace

SEGMENT, SEGMENTS, MAX_BITS = 16, 4, 3
#: Running budgets of a chain of one to four segments.
BUDGETS = tuple(MAX_BITS * n // SEGMENTS for n in range(1, SEGMENTS + 1))
#: Members of one block of a frequent key; two blocks at most meet in one comparison.
BLOCK = 1024
#: Shingles hashed before their bits are summed.
SHINGLE_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - size + 1
    first, last = starts[:n].tolist(), ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLE_CHUNK):
        part = zip(first[k : k + SHINGLE_CHUNK], last[k : k + SHINGLE_CHUNK], strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(rows, run, "doc_id long, fp long")


def _turn(fp, segment: int):
    """The fingerprint with ``segment`` first (in the low bits)."""
    return fp if segment == 0 else F.shiftrightunsigned(fp, SEGMENT * segment).bitwiseOR(F.shiftleft(fp, 64 - SEGMENT * segment))


def ring_keys(classes: DataFrame) -> DataFrame:
    """(key, start, fp, rep): the eight 24-bit keys of each class, tagged with start segment and half."""
    keys = []
    for s in range(SEGMENTS):
        ring = _turn(F.col("fp"), s)
        for half in range(2):
            low = ring.bitwiseAND(F.lit((1 << SEGMENT) - 1))
            piece = F.shiftrightunsigned(ring, SEGMENT + 8 * half).bitwiseAND(F.lit(255))
            keys.append(F.lit(2 * s + half) * (1 << 24) + F.shiftleft(piece, SEGMENT) + low)
    return classes.select("fp", "rep", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))


def chain_links(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Positions of the pairs whose chain from segment ``start`` stays within every budget."""
    turn = (start * SEGMENT).astype(np.uint64)
    diff = x ^ y
    diff = np.where(turn > 0, (diff >> turn) | (diff << ((np.uint64(64) - turn) % np.uint64(64))), diff)
    left, total = np.arange(len(diff)), np.zeros(len(diff), np.int64)
    for i, budget in enumerate(BUDGETS):
        total = total[: len(left)] + np.bitwise_count((diff >> np.uint64(SEGMENT * i)) & np.uint64((1 << SEGMENT) - 1))
        good = total <= budget
        left, diff, total = left[good], diff[good], total[good]
    return left


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each pair; the smaller position becomes the root."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)


def forest(group: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the links inside runs of equal ``group``; linear in the members.

    Members at a growing distance inside their run are compared at once, which costs the
    pairs of a block but never keeps them; pairs already in one tree are skipped.
    """
    n = len(group)
    parent = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # members from here to the run's end
    active = np.flatnonzero(left > 1)
    d = 1
    while len(active):
        other = active + d
        hits = chain_links(fp[active], fp[other], start[active])
        if len(hits):
            _unite(parent, active[hits], other[hits])
        d += 1
        active = active[left[active] > d]
    root = _roots(parent, np.arange(n))
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between class representatives that span every component of the links."""
    keys = ring_keys(classes)
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = (
        lookup(keys, counts, ["key"], 2 * SEGMENTS * classes.count(), F.xxhash64("fp", "key"), "inner")
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "rep")
    )
    order = ["key", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            group = np.r_[0, np.cumsum(change)]
            member, root = forest(group, rows[:, 3].view(np.uint64), (rows[:, 0] >> 25).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(rows[member, 4]), pa.array(rows[root, 4])], ["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            if held and (rows[0, :3] != held[-1][-1, :3]).any():
                yield edges(held)
                held = []
            if len(change):
                cut = change[-1] + 1
                yield edges([*held, rows[:cut]])
                held = [rows[cut:]]
            else:
                held.append(rows)
        if held:
            yield edges(held)

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame, path: str, nodes: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge.

    Each round turns every node's larger neighbours to its smallest neighbour, then every
    node's smaller neighbours likewise, and ends when the edges are stars.  A round is two
    partial aggregations and two joins over written tables.  ``nodes`` is about their number.
    """

    def key(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def turned(e: DataFrame, total: int) -> DataFrame:
        """(a, b, m): the edges with the smallest node ``m`` that ``a`` has as neighbour."""
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        return lookup(e, low, ["a"], total, F.xxhash64("a", "b"))

    # an edge is kept as (larger, smaller)
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{path}/round-0", nodes)
    mark = key(now)
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = turned(both, 2 * mark[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # the smallest neighbour itself gives the edge that keeps the node; any other gives the edge between the two
        small = turned(large, mark[0]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/round-{i}", mark[0])
        new_mark = key(new)
        discard(edges.sparkSession, f"{path}/round-{i - 1}")
        now, done = new, new_mark == mark
        if done:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and its component's smallest doc_id."""
    path = workspace(docs.sparkSession, "simhash")
    rows = stored(fingerprints(docs, id_col, text_col), f"{path}/rows")
    n = rows.count()
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), f"{path}/classes", n)
    edges = links(classes.filter("rep is not null"), block)
    # one doc_id may stand in several classes; its edges then meet in the same node
    stars = components(edges, f"{path}/stars", n)
    same = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").limit(1)
    if not same.isEmpty():
        shared = lookup(rows, classes, ["fp"], n, F.xxhash64("doc_id")).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        stars = components(edges.unionByName(shared), f"{path}/stars-again", n)
    owned = stored(classes.join(stars, classes.rep == stars.node, "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id")), f"{path}/owned", n)
    for used in ("classes", "stars", "stars-again"):
        discard(docs.sparkSession, f"{path}/{used}")
    return lookup(rows, owned, ["fp"], n, F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Of rows that share this doc_id the one with the smallest text hash stays, then the one
    whose row is smallest as JSON; rows without doc_id all stay.
    """
    found = near_duplicates(docs, id_col, text_col, block)
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias("head")).distinct()
    # each row travels as one struct, so no column name of the table can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = Window.partitionBy("head").orderBy(F.xxhash64(F.col(f"row.`{text_col}`")), F.to_json("row"))
    kept = rows.join(heads, F.col(f"row.`{id_col}`").cast("long") == F.col("head")).withColumn("place", F.row_number().over(order)).filter("place = 1")
    return kept.select("row.*").unionByName(docs.filter(F.col(id_col).isNull()))

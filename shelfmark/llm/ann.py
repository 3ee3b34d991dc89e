"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Every vector is projected by a fixed Gaussian matrix, so a projected squared distance over
the true one follows a chi-square law with as many degrees as projections.  A kd-tree over
the projections indexes all rows.  A query takes its projected neighbours one after the
other, nearest first, and verifies each by its true distance until the chi-square test
holds: a point as far away in projection as the next one would be nearer than ``1 / ratio``
of the k-th distance with probability below ``1 - confidence``.

The tree's upper levels cut the rows into cells.  They are fitted on a bounded sample, at
most ``SAMPLE_ROWS`` projected rows for each length of vector; every row is indexed.  A cell
of more rows than a shard may hold, however many of them are equal, is split further by a
hash of the ids.  A task builds the lower levels of one shard and reads that shard's queries
batch by batch, so it holds a shard and one batch.  Each query first looks into one shard of
its own cell; the k-th distance found there bounds the second pass, in which it visits only
the cells that come near enough in projection for the test.  No pair of rows is kept beyond
the k best of a shard.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite numbers
take no part; only vectors of equal length are compared; rows that repeat an id with equal
vectors count once, and of a repeated query id the smallest vector asks; a query with fewer
than k candidates gets them all; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import in_small_batches

PROJECTIONS, CONFIDENCE, RATIO, SEED = 16, 0.95, 1.0, 20_240
LEAF = 32
#: Most rows and most bytes of vectors in a shard.
SHARD_ROWS, SHARD_BYTES = 1 << 14, 32 << 20
#: Projected rows that the upper levels are fitted on, and how many of them a cell has at least.
SAMPLE_ROWS, CELL_SAMPLE = 1 << 17, 16
#: Points verified at once, first and at most.
FIRST_CHUNK, LAST_CHUNK = 64, 4096
#: Pairs of query and cell looked at in one step.
REACH_STEP = 1 << 17
#: Keeps equal vectors together whatever rounding did to their projections.
SLACK = 1e-9


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value below which a chi-square variable of an even number of degrees lies with probability ``p``."""

    def below(x: float) -> float:
        term = total = 1.0
        for k in range(1, degrees // 2):
            term *= x / 2 / k
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dimension: int, width: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, width))


def projected(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projections in double precision, some rows at a time."""
    out = np.empty((len(vectors), matrix.shape[1]))
    for i in range(0, len(vectors), 4096):
        out[i : i + 4096] = vectors[i : i + 4096].astype(np.float64) @ matrix
    return out


class Cells:
    """The upper levels of the tree: a complete binary tree of cuts, in heap order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(max(1 << depth, 1), np.int64), np.zeros(max(1 << depth, 1))
        level = [points]
        for d in range(depth):
            below = []
            for i, part in enumerate(level):
                node = (1 << d) + i
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if len(part) else 0
                cut = float(np.median(part[:, axis])) if len(part) else 0.0
                self.axis[node], self.cut[node] = axis, cut
                right = part[:, axis] >= cut
                below += [part[~right], part[right]]
            level = below

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.ones(len(points), np.int64)
        at = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[at, self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def within(self, points: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, cells): the cells whose squared distance from a point is at most its ``radius``."""
        step = max(1, REACH_STEP >> self.depth)
        for first in range(0, len(points), step):
            who = np.arange(first, min(first + step, len(points)))
            node, gap, off = np.ones(len(who), np.int64), np.zeros(len(who)), np.zeros((len(who), points.shape[1]))
            for _ in range(self.depth):
                axis = self.axis[node]
                beyond = points[who, axis] - self.cut[node]
                near = 2 * node + (beyond >= 0)
                at = np.arange(len(who))
                far_gap = gap - off[at, axis] + beyond * beyond
                far = far_gap <= radius[who]
                far_off = off[far]
                far_off[np.arange(len(far_off)), axis[far]] = beyond[far] ** 2
                who, node, gap, off = np.r_[who, who[far]], np.r_[near, near[far] ^ 1], np.r_[gap, far_gap[far]], np.concatenate([off, far_off])
            yield who, node - (1 << self.depth)


class Shard:
    """The lower levels of the tree for one shard; leaves are runs of rows with a projected box each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray, confidence: float = CONFIDENCE, ratio: float = RATIO, leaf: int = LEAF):
        self.matrix = matrix
        self.scale = chi_square_quantile(confidence, matrix.shape[1]) / ratio**2
        points = projected(vectors, matrix)
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                leaves.append(part)
                continue
            own = points[part]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            halves = np.argpartition(own[:, axis], len(part) // 2)
            todo += [part[halves[: len(part) // 2]], part[halves[len(part) // 2 :]]]
        leaves = [x for x in leaves if len(x)]
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.start = np.r_[0, np.cumsum([len(x) for x in leaves])].astype(np.int64)
        inner = self.start[:-1]
        self.low, self.high = (np.minimum.reduceat(self.points, inner), np.maximum.reduceat(self.points, inner)) if leaves else (self.points, self.points)
        #: Rows verified and rows asked about, over all queries.
        self.verified = self.asked = 0

    def nearest(self, query: np.ndarray, k: int, own: int | None = None, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """About the k nearest (distances, ids) within ``bound``, ties by id, rows of the id ``own`` left out."""
        self.asked += len(self.ids)
        query = query.astype(np.float64)
        q = query @ self.matrix
        away = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        frontier = (away * away).sum(axis=1)
        leaves = np.argsort(frontier, kind="stable")
        frontier = np.r_[frontier[leaves], np.inf]
        best_d, best_i, kth = np.zeros(0), np.zeros(0, np.int64), bound
        wait_gap, wait_row = np.zeros(0), np.zeros(0, np.int64)  # projected neighbours not yet verified, nearest first
        opened, group, chunk = 0, 4, FIRST_CHUNK
        while True:
            limit = self.scale * kth * kth + SLACK
            if opened < len(leaves) and frontier[opened] <= limit:
                some = leaves[opened : opened + group]
                rows = np.concatenate([np.arange(self.start[x], self.start[x + 1]) for x in some])
                gap = self.points[rows] - q
                gap = np.einsum("ij,ij->i", gap, gap)
                opened, group = opened + group, group * 2
                near = gap <= limit
                wait_gap, wait_row = np.r_[wait_gap, gap[near]], np.r_[wait_row, rows[near]]
                order = np.argsort(wait_gap, kind="stable")
                wait_gap, wait_row = wait_gap[order], wait_row[order]
            elif not len(wait_gap) or wait_gap[0] > limit:
                break
            # the next projected neighbours are those that come before every unopened leaf
            sure = frontier[min(opened, len(leaves))]
            ready = int(np.searchsorted(wait_gap, sure, "right"))
            while ready and wait_gap[0] <= self.scale * kth * kth + SLACK:
                n = min(ready, chunk)
                chunk = min(2 * chunk, LAST_CHUNK)
                gap, rows = wait_gap[:n], wait_row[:n]
                wait_gap, wait_row, ready = wait_gap[n:], wait_row[n:], ready - n
                diff = self.vectors[rows] - query
                d, i = np.sqrt(np.einsum("ij,ij->i", diff, diff)), self.ids[rows]
                taken = self._taken(gap, np.where(i == own, np.inf, d), best_d, k, kth)
                self.verified += taken
                d, i = d[:taken], i[:taken]
                good = (d <= kth) & (i != own)
                best_d, best_i = np.r_[best_d, d[good]], np.r_[best_i, i[good]]
                order = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[order], best_i[order]
                if len(best_d) == k:
                    kth = min(kth, best_d[-1])
                if taken < n:
                    return best_d, best_i
            if ready:
                break
        return best_d, best_i

    def _taken(self, gap: np.ndarray, d: np.ndarray, best: np.ndarray, k: int, kth: float) -> int:
        """How many of these projected neighbours are verified when the test is made after each."""
        both = np.r_[best, d]
        last = min(kth, np.partition(both, k - 1)[k - 1]) if len(both) >= k else kth
        if gap[-1] <= self.scale * last * last + SLACK:
            return len(gap)  # the test only gets sharper, so it held for all
        heap = [-x for x in best]
        heapq.heapify(heap)
        for n, (g, x) in enumerate(zip(gap.tolist(), d.tolist(), strict=True)):
            if g > self.scale * kth * kth + SLACK:
                return n
            heapq.heappush(heap, -x)
            if len(heap) > k:
                heapq.heappop(heap)
            if len(heap) == k:
                kth = min(kth, -heap[0])
        return len(gap)


def usable(vector: Column) -> Column:
    """Is this a vector of finite numbers, not all zero?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, vectors) of a column of vectors."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
    for size in np.unique(sizes).tolist():
        here = np.flatnonzero(sizes == size)
        yield size, here, flat[first[here][:, None] + np.arange(size)]


def _once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that repeat an id with an equal vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    at = list({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors, strict=True))}.values())
    return ids[at], vectors[at]


def shard_rows(size: int, rows: int = SHARD_ROWS) -> int:
    """Most rows of a shard for vectors of this length (of 8 bytes a number)."""
    return max(1, min(rows, SHARD_BYTES // (8 * size)))


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    confidence: float = CONFIDENCE, projections: int = PROJECTIONS, ratio: float = RATIO, most_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest rows of each query, its own row left out."""
    kind = rows.schema[vector_col].dataType
    kind = kind.simpleString() if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("vector")))

    rows, queries = clean(rows), clean(queries)
    # lengths of which one shard cannot hold all rows; there are fewer of them than shards
    counts = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    large = {r["size"]: r["n"] for r in counts.filter(F.col("n") > F.least(F.lit(most_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES // 8) / F.col("size"))))).collect()}
    trees = {size: _upper_levels(rows, size, n, projections, most_rows) for size, n in large.items()}

    def place(df: DataFrame) -> DataFrame:
        """Adds the cell of each row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                for size, at, vectors in _by_size(batch.column(1)):
                    if size in trees:
                        cell[at] = trees[size].of(projected(vectors, projection(size, projections)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "vector", "cell"])

        if not trees:
            return df.withColumn("cell", F.lit(0))
        return in_small_batches(df, run, f"id long, vector {kind}, cell int")

    placed = place(rows)
    # cells of more rows than a shard may hold, a few numbers
    parts = {}
    if trees:
        full = placed.groupBy(F.size("vector").alias("size"), "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.least(F.lit(most_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES // 8) / F.col("size")))))
        parts = {(r["size"], r["cell"]): -(-r["n"] // shard_rows(r["size"], most_rows)) for r in full.collect()}
    shards = 1 + sum(1 << t.depth for t in trees.values()) + sum(parts.values())
    tasks = min(4 * shards, 20_000)
    split = F.lit(1)
    for (size, cell), n in parts.items():
        split = F.when((F.size("vector") == size) & (F.col("cell") == cell), n).otherwise(split) if len(parts) <= 64 else split
    if len(parts) > 64:
        known = F.create_map(*[F.lit(x) for (size, cell), n in parts.items() for x in (f"{size}:{cell}", n)])
        split = F.coalesce(F.element_at(known, F.concat_ws(":", F.size("vector"), "cell")), F.lit(1))
    part = F.pmod(F.xxhash64("id"), split).cast("int")
    indexed = placed.withColumn("part", part).select(F.size("vector").alias("size"), "cell", "part", F.lit(False).alias("asks"), "id", "vector", F.lit(0.0).alias("bound"))
    asked = place(queries.groupBy("id").agg(F.min("vector").alias("vector"))).withColumn("part", part)
    asked = asked.select(F.size("vector").alias("size"), "cell", "part", F.lit(True).alias("asks"), "id", "vector", F.lit(float("inf")).alias("bound"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard's rows come first, then its queries, of which one batch is held at a time
        now, ids, held, tree = None, [], [], None
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                (*shard, asks), run = keys[i].tolist(), batch.slice(i, j - i)
                if shard != now:
                    now, ids, held, tree = shard, [], [], None
                own, (_, _, vectors) = run.column(4).to_numpy(), next(_by_size(run.column(5)))
                if not asks:
                    ids.append(own)
                    held.append(vectors)
                    continue
                if tree is None and held:
                    tree = Shard(*_once(np.concatenate(ids), np.concatenate(held)), projection(shard[0], projections), confidence, ratio)
                    ids, held = [], []
                if tree is None:
                    continue
                found = [tree.nearest(v, k, q, b) for q, v, b in zip(own.tolist(), vectors, run.column(6).to_pylist(), strict=True)]
                asker = np.repeat(own, [len(d) for d, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(np.concatenate([i for _, i in found]).astype(np.int64)), pa.array(np.concatenate([d for d, _ in found]))], ["query_id", "vec_id", "score"])

    def look(asked: DataFrame) -> DataFrame:
        shard = ["size", "cell", "part"]
        met = indexed.unionByName(asked).repartition(tasks, *shard).sortWithinPartitions(*shard, "asks")
        return in_small_batches(met, answer, "query_id long, vec_id long, score double")

    best = look(asked)
    if trees:
        scale = chi_square_quantile(confidence, projections) / ratio**2

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The other shards that a query has to visit, given what its first one found."""
            for batch in batches:
                bound = batch.column(4).to_numpy(zero_copy_only=False)
                home = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (2, 3)], axis=1)
                for size, at, vectors in _by_size(batch.column(1)):
                    if size not in trees:
                        continue
                    far = np.nan_to_num(scale * bound[at] ** 2 + SLACK, posinf=np.inf)
                    for who, cells in trees[size].within(projected(vectors, projection(size, projections)), far):
                        n = np.array([parts.get((size, c), 1) for c in cells.tolist()], np.int64)
                        who, cells, step = np.repeat(who, n), np.repeat(cells, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        other = (cells != home[at[who], 0]) | (step != home[at[who], 1])
                        rows = pa.array(at[who[other]])
                        for i in range(0, len(rows), 4096):
                            some = rows.slice(i, 4096)
                            here = slice(i, i + 4096)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(some), size, np.int32)), pa.array(cells[other][here].astype(np.int32)), pa.array(step[other][here].astype(np.int32)), pa.array([True] * len(some)), batch.column(0).take(some), batch.column(1).take(some), batch.column(4).take(some)],
                                ["size", "cell", "part", "asks", "id", "vector", "bound"],
                            )

        kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("kth"))
        again = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "vector", "cell", "part", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
        visits = in_small_batches(again, reach, f"size int, cell int, part int, asks boolean, id long, vector {kind}, bound double")
        best = best.unionByName(look(visits))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _upper_levels(rows: DataFrame, size: int, n: int, projections: int, most_rows: int) -> Cells:
    """The cells of one length of vector, fitted on a sample of bounded size by a hash of the ids."""
    depth = max(0, int(np.ceil(np.log2(n / shard_rows(size, most_rows)))))
    wanted = min(SAMPLE_ROWS, max(1024, CELL_SAMPLE * 4 << depth))
    scale = 1 << 30
    share = min(scale, -(-wanted * scale // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, vectors in _by_size(batch.column(1)):
                points = projected(vectors, projection(size, projections))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([p.tobytes() for p in points], pa.binary())], ["id", "point"])

    chosen = rows.filter((F.size("vector") == size) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(scale)) < share))
    # rows that share an id share their hash, so the limit and not the share bounds the sample
    found = in_small_batches(chosen, run, "id long, point binary").orderBy("id", "point").limit(2 * wanted).toArrow()
    points = np.array([np.frombuffer(p, np.float64) for p in found["point"].to_pylist()]).reshape(-1, projections)
    return Cells(points, min(depth, max(0, int(np.log2(max(len(points), 1) / CELL_SAMPLE)))))

"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are scaled to length 1 (nearness by cosine is then Euclidean) and
projected by Gaussian directions, a 2-stable family: the squared projected
distance over the squared true distance follows chi-square with as many degrees
of freedom as there are directions. Neighbours are taken by projected distance:
a kd-tree gives its leaves by their least one, and of their members those are
verified that the test leaves open. A vector is left out, and a query ends, once
the chi-square test says that a vector nearer than the k-th best so far would
have been met before with probability ``sure``.

Every distinct vector is indexed, in regions of the projected space that a
kd-tree over a bounded sample cuts. A query first searches its own region; the
distance of its k-th best there tells which other regions can hold better ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyecho.llm.common import clashing, shuffle_width, written

#: Directions (an even number): fewer make leaves prune better, more make the test sharper.
DIRECTIONS = 12
LEAF = 64
SHARD_ROWS = 16_384
#: Vectors that the regions are cut by.
SAMPLE = 32_768
#: How likely each true neighbour is to pass the test.
SURE = 0.98


@lru_cache(8)
def chi_square_limit(sure: float, freedom: int = DIRECTIONS) -> float:
    """The value that a chi-square variable (even degrees of freedom) stays under with probability ``sure``."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 500.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Places of the points, by leaf of a tree that halves along the widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        values = points[own]
        side = int((values.max(axis=0) - values.min(axis=0)).argmax())
        order = np.argpartition(values[:, side], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((dimension, DIRECTIONS))


class Regions:
    """Boxes of the projected space, about as many as asked for, with equal parts of the sample in each."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        wide = np.full(DIRECTIONS, np.inf)
        self.root = self._grow(sample, -wide, wide, count)
        self.low_, self.high_ = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, count: int) -> int:
        """A node's number, or for a region -1 less its own."""
        side = int((points.max(axis=0) - points.min(axis=0)).argmax()) if len(points) else 0
        cut = float(np.median(points[:, side])) if len(points) else 0.0
        left = points[:, side] <= cut
        if count <= 1 or len(points) < 2 or left.all():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        at = len(self.nodes)
        self.nodes.append((side, cut, 0, 0))
        below, above = high.copy(), low.copy()
        below[side] = above[side] = cut
        first = self._grow(points[left], low, below, (count + 1) // 2)
        self.nodes[at] = (side, cut, first, self._grow(points[~left], above, high, count // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                side, cut, first, second = self.nodes[node]
                left = points[own, side] <= cut
                todo += [(first, own[left]), (second, own[~left])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """The squared distance from the point to each region."""
        gap = np.maximum(np.maximum(self.low_ - point, point - self.high_), 0)
        return (gap * gap).sum(axis=1)


class Index:
    """The projected kd-tree over the distinct vectors of a region; ``ids`` has for each the smallest ids of its rows."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.length[:, None]
        self.directions = directions(vectors.shape[1])
        projected = self.unit @ self.directions
        leaves = kd_leaves(projected)
        self.members = np.concatenate(leaves)
        self.bounds = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([projected[x].min(axis=0) for x in leaves])
        self.high = np.array([projected[x].max(axis=0) for x in leaves])
        self.ordered, self.projected = self.unit[self.members], projected[self.members]

    def search(self, query_id: int, query: np.ndarray, k: int, limit: float, reach: float = 4.0) -> tuple[list[tuple[int, float]], int]:
        """The k nearest members but ``query_id`` within a squared distance of ``reach`` (4: any), nearest first, as far as the
        test lets them be found: ids and scores; and how many vectors were verified."""
        length = math.sqrt(float((query * query).sum()))
        unit = query / length
        p = unit @ self.directions
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        distance = (gap * gap).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        places, scores = [np.empty(0, np.int64)], [np.empty(0)]
        best = np.empty(0)
        step, at = 4, 0
        while at < len(order) and distance[order[at]] < limit * reach:
            near = np.concatenate([np.arange(self.bounds[x], self.bounds[x + 1]) for x in order[at : at + step]])
            away = self.projected[near] - p
            near = near[(away * away).sum(axis=1) < limit * reach]
            score = self.ordered[near] @ unit
            places.append(near)
            scores.append(score)
            best = np.concatenate([best, score])
            if len(best) > k + 1:
                best = np.partition(best, len(best) - k - 1)[-(k + 1) :]
            if len(best) == k + 1:  # k + 1, as the query itself may be among them; a margin for rounding keeps ties in
                reach = min(reach, max(0.0, 2 - 2 * float(best.min())) + 1e-9)
            at += step
            step = min(64, step * 2)
        places, scores = np.concatenate(places), np.concatenate(scores)
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k + 1 else -2
        members = self.members[places[scores >= least - 1e-9]]
        exact = (self.vectors[members] * query).sum(axis=1) / (self.length[members] * length)
        got = sorted(((-s, int(i)) for m, s in zip(members, exact.tolist(), strict=True) for i in self.ids[m] if i != query_id))
        return [(i, -s) for s, i in got[:k]], len(scores)


def usable(vector: str, dimension: int) -> Column:
    """Not null, of the dimension, all components finite numbers, and not all zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) == dimension) & ~bad & F.exists(x, lambda v: v != 0)


def nearest(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", sure: float = SURE, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows by cosine to each row where ``queries`` holds, itself left out:
    query_id, rank from 1, the key, the score and ``verified``, how many vectors were measured for the query; ties to smaller keys.

    Keys are integers; a key named as one of those columns is an error. Vectors that are null, zero, hold null or
    non-finite components, or differ in dimension from the most common one take no part. Rows that repeat a key are
    members of their own, and none of them is a neighbour of that key; a repeated query answers once, with its least vector.
    The regions are cut by the ``sample`` distinct vectors with the smallest hashes. A task holds one region's
    distinct vectors, about ``shard_rows``, and streams the queries that visit it.
    """
    spark = df.sparkSession
    clashing(df.select(key), "query_id", "rank", "score", "verified")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("_ask")).where(F.col("id").isNotNull())
    kind = f"query_id long, rank int, {key} long, score double, verified long"
    common = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(usable("v", common["n"]))
    # Equal vectors have equal scores, so only the smallest ids of a group can be among the nearest; the rest goes before the shuffle.
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    vectors = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asks = written(rows.where("_ask").groupBy("id").agg(F.min("v").alias("v")), "asks")
    count = vectors.count()
    spread = F.pmod(F.xxhash64("v", F.lit(2)), F.lit(1 << 24))
    rate = min(1.0, 1.5 * sample / max(1, count))
    chosen = vectors.where(spread < int(rate * (1 << 24)) + 1).select("v").orderBy(spread, "v").limit(sample).collect()  # at most ``sample`` vectors
    if not chosen:
        return spark.createDataFrame([], kind)
    points = np.array([r["v"] for r in chosen])
    regions = Regions(points / np.sqrt((points * points).sum(axis=1))[:, None] @ directions(common["n"]), max(1, math.ceil(count / shard_rows)))
    shared = spark.sparkContext.broadcast(regions)  # of the size of the sample at most
    limit = chi_square_limit(sure)
    index = written(vectors.mapInArrow(_placed(shared, "ids"), "ids array<long>, v array<double>, shard int"), "index")
    homes = written(asks.mapInArrow(_placed(shared, "id"), "id long, v array<double>, shard int"), "homes")
    out = f"query_id long, {key} long, score double, verified long"

    def searched(visits: DataFrame) -> DataFrame:
        own = index.select("shard", F.lit(None).cast("long").alias("id"), "ids", "v", F.lit(0.0).alias("reach"))
        both = own.unionByName(visits.select("shard", "id", F.lit(None).cast("array<long>").alias("ids"), "v", "reach"))
        dealt = both.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard", F.col("id").isNotNull(), "id")
        return dealt.mapInArrow(_searcher(k, key, limit), out)

    near = written(searched(homes.withColumn("reach", F.lit(4.0))), "near")
    kth = near.where(F.col(key).isNotNull()).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    told = homes.join(kth, "id", "left").withColumn("reach", F.coalesce(2 - 2 * F.col("least") + 1e-9, F.lit(4.0)))
    far = searched(told.select("id", "v", "shard", "reach").mapInArrow(_visits(shared, limit), "shard int, id long, v array<double>, reach double"))
    all_ = near.unionByName(far)
    total = all_.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    best = all_.where(F.col(key).isNotNull()).drop("verified").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(total, "query_id").select("query_id", F.col("rank").cast("int"), key, "score", "verified")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projections(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None] @ directions(v.shape[1])


def _placed(shared: Broadcast, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(batch.schema.get_field_index("v"))
                at = shared.value.of(_projections(_matrix(v)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(name)), v, pa.array(at, pa.int32())], [name, "v", "shard"])

    return run


def _visits(shared: Broadcast, limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for every region but its own that can hold a vector nearer to a query than its k-th best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions: Regions = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            home, reach = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, p in enumerate(_projections(_matrix(batch.column(1)))):
                there = np.flatnonzero(regions.gaps(p) < limit * reach[i])
                there = there[there != home[i]].astype(np.int32)
                take = pa.array(np.full(len(there), i))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(batch.column(c).take(take) for c in (0, 1, 3))], ["shard", "id", "v", "reach"])

    return run


def _searcher(k: int, key: str, limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows by region, its vectors before its queries: each query gets its nearest ones there, and a row without any that
    says how many were verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        ids: list[list[int]] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1)
            is_query = np.array(asks.is_valid())
            v = _matrix(batch.column(3)) if batch.num_rows else None
            out: list[tuple] = []
            bounds = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (is_query[1:] != is_query[:-1]), [True]))) if batch.num_rows else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if shards[a] != shard:
                    shard, index, ids, parts = shards[a], None, [], []
                if not is_query[a]:
                    ids += batch.column(2).slice(a, b - a).to_pylist()
                    parts.append(v[a:b])
                elif parts:
                    index = index or Index(ids, np.concatenate(parts))
                    for q, x, reach in zip(asks.slice(a, b - a).to_pylist(), v[a:b], batch.column(4).slice(a, b - a).to_pylist(), strict=True):
                        got, verified = index.search(q, x, k, limit, reach)
                        out += [(q, i, s, 0) for i, s in got] + [(q, None, None, verified)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", key, "score", "verified"])

    return run


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> float:
    """The share of ``truth`` pairs that ``found`` has."""
    n = truth.count()
    return truth.join(found.select("query_id", key).distinct(), ["query_id", key]).count() / n if n else 1.0


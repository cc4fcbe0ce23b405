"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyecho.llm.common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of this partition's links under the smallest it reaches within the partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (to := up.get(top, top)) != top:
            top = to
        while (to := up.get(x, x)) != top:
            up[x] = top
            x = to
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    vertices = list(up)
    for at in range(0, len(vertices), 50_000):
        own = vertices[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([root(x) for x in own], pa.int64())], ["v", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v`` and ``root``, the smallest vertex that it is linked with over any path, for every
    vertex of ``links`` (integers) but the roots themselves.

    Rounds of contraction: the links of each vertex meet in one partition, where
    they shrink to a forest, then every vertex moves from its root to that root's
    root. Ends when all trees are stars; each round is stored.
    """
    now = written(links.select(F.col(a).cast("long"), F.col(b).cast("long")).where(f"{a} <> {b}").mapInArrow(_forest, "v long, root long"), "links")
    while True:
        trees = written(now.select("v", "root").repartition("v").mapInArrow(_forest, "v long, root long"), "trees")
        above = trees.groupBy("v").agg(F.min("root").alias("above"), F.count("*").alias("n")).withColumnRenamed("v", "of")
        now = written(trees.join(above, trees["root"] == above["of"], "left").select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "trees")
        several = now.groupBy("v").agg((F.min("root") != F.max("root")).alias("s"), F.max("moved").alias("m")).where("s or m")
        if several.isEmpty():
            return now.select("v", "root").distinct()

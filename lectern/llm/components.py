"""Connected components: alternating star contractions in DataFrame operations, and one task for the links once they are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import join_groups, prepare, remove_checkpoint

MAX_ROUNDS = 60


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links i-j connect it with."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def _in_one_task(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the (materialised, few) links ``(u, v)``."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        parts = [(b.column(0), b.column(1)) for b in batches]
        if parts:
            u, v = (pa.concat_arrays(x) for x in zip(*parts, strict=True))
            node, at = np.unique(np.concatenate([u.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)]), return_inverse=True)
            root = node[forest(len(node), at[: len(u)], at[len(u) :])]
            yield pa.RecordBatch.from_arrays([pa.array(node, u.type), pa.array(root, u.type)], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link, root the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the least node it
    knows (large star, small star); rounds grow with the logarithm of the longest path. Least
    neighbours are partial aggregates, and a hub's links are dealt over several tasks
    (:func:`join_groups`), so none gathers a hub. Once a round's count shows that at most
    ``common.BROADCAST_ROWS`` links are left, one task finishes them: a round of few links costs a dozen
    shuffles of almost empty files. Each round's files go when the next has written its own. Nulls and
    self-links are dropped; no links give no rows.
    """
    spark = links.sparkSession
    prepare(spark)
    found = (
        links.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .checkpoint()
    )
    if found.count() <= common.BROADCAST_ROWS:
        return _in_one_task(found)
    stars, before = found.distinct().checkpoint(), None
    remove_checkpoint(found)
    for _ in range(MAX_ROUNDS):
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] <= common.BROADCAST_ROWS:
            return _in_one_task(stars)
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
        old, before = stars, mark
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_groups(both, least, "u", "n", 2 * mark["n"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        stars = (
            join_groups(large, down, "u", "n", 2 * mark["n"], ["v"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", "m")).distinct().checkpoint()
        )
        remove_checkpoint(old)
    raise RuntimeError("components did not settle")

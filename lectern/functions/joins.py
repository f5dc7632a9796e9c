"""Joins that compare all rows of a key with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import kept

#: Pairs that one task compares. A join of more is dealt over tasks, and a key that has more over several.
PAIRS = 1 << 24
#: Tasks of a join that is dealt, at most.
MOST_TASKS = 2000


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], salt: list[str], hit: Column | None = None) -> DataFrame:
    """Inner join on equal ``on``, columns as ``l.`` and ``r.``; ``hit``: what else a pair must fulfil.

    Both sides are counted by key first. A key with over PAIRS pairs is dealt by a hash of the left rows' ``salt`` into
    pieces of about that many, and its right rows are copied to each; no pair is left out.
    """
    many = left.groupBy(*on).agg(F.count("*").alias("_n")).join(right.groupBy(*on).agg(F.count("*").alias("_m")), on)
    pairs = F.col("_n") * (F.col("_m") / PAIRS)
    many = many.select(*on, pairs.alias("_share"), F.least("_n", F.ceil(pairs)).alias("_pieces"))
    share, pieces = many.agg(F.sum("_share"), F.sum(F.when(F.col("_pieces") > 1, F.col("_pieces")))).first()
    same = on
    if (share or 0) > 1:
        hot = F.broadcast(kept(many.where("_pieces > 1").select(*on, "_pieces")))
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(max(int(share), pieces or 0), MOST_TASKS))
        # one column, so that the optimizer finds no constant in it, and the shuffle stays as it is dealt here
        at, of, same = F.struct(*on, "_piece"), F.coalesce("_pieces", F.lit(1).cast("bigint")), ["_at"]
        piece, every = F.pmod(F.xxhash64(*salt), of), F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1))
        left, right = (
            x.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).join(hot, on, "left").withColumn("_piece", p).withColumn("_at", at).drop("_piece", "_pieces").repartition(tasks, "_at")
            for x, p in ((left, piece), (right, every))
        )
    equal = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in same]
    return left.alias("l").join(right.alias("r"), equal if hit is None else [*equal, hit])

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, rounds: int = 60, file_rows: int = 500_000) -> DataFrame:
    """``id`` and ``class_id`` (the least id of its component) of every id in ``x`` or ``y``.

    Each round is written to the shared folder; only a count and a checksum, observed while it is
    written, reach the driver. A centre with very many neighbours is a plain aggregate and a join
    that can be split. Null ends are no edges.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def written(df: DataFrame, most: int | None) -> tuple[DataFrame, dict]:
        seen = Observation()
        counted = canonical(df).observe(seen, F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return stage(counted, "edges", files=None if most is None else max(1, -(-most // file_rows))), dict(seen.get)

    now, seen = written(edges.select(F.col("x").alias("u"), F.col("y").alias("v")), None)
    for _ in range(rounds if seen.get("n") else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = canonical(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(nearest.select("u", F.col("m").alias("v")))
        now, after = written(small, 2 * seen["n"])  # a round leaves no more edges than both steps make of one
        if after == seen:
            break
        seen = after
    else:
        if seen.get("n"):
            raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
    return members.unionByName(members.select(F.col("class_id").alias("id"), "class_id").distinct())

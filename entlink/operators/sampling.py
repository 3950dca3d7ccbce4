"""Deterministic samples and splits, by a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024  # of priorities, within a stratum


def priority(seed: int, id_col: str = "entity_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col)))


def bottom_k(df: DataFrame, n: int, seed: int, id_col: str = "entity_id", exclude: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows of lowest priority, ids of ``exclude`` left out."""
    rows = df if exclude is None else df.join(exclude.select(id_col), id_col, "left_anti")
    return rows.orderBy(priority(seed, id_col), id_col).limit(n)


def placed(df: DataFrame, strata: list[str], seed: int, id_col: str) -> DataFrame:
    """``_place`` (from 1 by priority) in the stratum, and the stratum's ``_size``.

    Priorities are uniform, so their first digits cut a stratum into even ranges. A row's place is
    its place in the range, a task of its own, and the rows of the ranges before.
    """
    rows = df.withColumn("_priority", priority(seed, id_col))
    rows = rows.withColumn("_range", (F.conv(F.substring("_priority", 1, 4), 16, 10).cast("int") * RANGES / 65536).cast("int"))
    sizes = rows.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*strata)
    before = sizes.select(*strata, "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*strata, "_range")]
    joined = rows.alias("a").join(before.alias("b"), same).select("a.*", "_before", "_size")
    place = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_priority", id_col)) + F.col("_before")
    return joined.withColumn("_place", place).drop("_priority", "_range", "_before")


def stratified_split(df: DataFrame, strata: list[str], shares: tuple[float, float] = (0.75, 0.875), seed: int = 2026, id_col: str = "entity_id") -> DataFrame:
    """``split``: train, tune or evaluation, by place in the stratum's order of priority. Null values are a stratum too."""
    share = (F.col("_place") - 0.5) / F.col("_size")
    rows = placed(df, strata, seed, id_col)
    return rows.withColumn("split", F.when(share <= shares[0], "train").when(share <= shares[1], "tune").otherwise("evaluation")).drop("_place", "_size")


def training_pool(truth: DataFrame, exact: DataFrame, others: DataFrame, per_source: int, seed: int = 180) -> DataFrame:
    """Distinct ids of true targets, candidates of exact keys, and a sample of ``per_source`` ids of every source."""
    drawn = placed(others.select("entity_id", "source"), ["source"], seed, "entity_id").where(F.col("_place") <= per_source).select("entity_id")
    return truth.select(F.col("target").alias("entity_id")).unionByName(exact.select(F.col("cand").alias("entity_id"))).unionByName(drawn).distinct()

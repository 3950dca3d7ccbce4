"""Ranked lists: top k, fusion, merges, lexical rank, and comparisons of search settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def top_k(scored: DataFrame, k: int | None = None, by: str = "s1", score: str = "score", tie: str = "cand") -> DataFrame:
    """``rank`` from 1 by falling score, ties by id; at most ``k`` rows a query."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 50) -> DataFrame:
    """Sum of 1 / (60 + rank) over the lists (``s1``, ``cand``, ``rank``); ties by id."""
    both = rankings[0].select("s1", "cand", "rank")
    for more in rankings[1:]:
        both = both.unionByName(more.select("s1", "cand", "rank"))
    return top_k(both.groupBy("s1", "cand").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score")), k)


def ranked_lists(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.groupBy("s1").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]).alias(name))


def hybrid(exact: Column, close: Column, limit: int) -> Column:
    """Half of the budget from ``exact``, the rest from ``close``, then what is left of both; each id once."""
    half = limit // 2
    return F.slice(F.array_distinct(F.concat(F.slice(exact, 1, half), F.slice(close, 1, limit - half), close, exact)), 1, limit)


def ordered_union(base: Column, extra: Column, limit: int | None = None) -> Column:
    both = F.array_distinct(F.concat(base, extra))
    return both if limit is None else F.slice(both, 1, limit)


def rescue_policies(base: Column, names: Column) -> dict[str, Column]:
    """The base list, with 5, 10 or 20 more by name, and a budget of 20 that keeps 15 and fills up."""
    out = {"baseline20": base}
    out |= {f"plus_name{n}": ordered_union(base, F.slice(names, 1, n)) for n in (5, 10, 20)}
    out["budget20"] = F.slice(F.array_distinct(F.concat(F.slice(base, 1, 15), F.slice(names, 1, 5), base)), 1, 20)
    return out


def lexical_score() -> Column:
    name, address = F.col("name_trigram_jaccard"), F.col("address_trigram_jaccard")
    return F.greatest(name, address) + 0.25 * F.least(name, address)


def rank_status(truth: DataFrame, ranked: DataFrame, threshold: float, k: int = 20) -> DataFrame:
    """Where each true link ended: not found, beyond the k-th place, accepted or rejected."""
    joined = truth.join(ranked.select("s1", F.col("cand").alias("target"), "rank", "score"), ["s1", "target"], "left")
    status = F.when(F.col("rank").isNull(), "absent_from_ann").when(F.col("rank") > k, f"outside_top{k}").when(F.col("score") >= threshold, "classifier_accepted").otherwise("classifier_rejected")
    return joined.select("s1", "target", status.alias("status"))


def pareto(rows: DataFrame, good: str = "macro_f05", cost: str = "seconds") -> DataFrame:
    """Rows that no other is as good and as cheap as, and better in one.

    One row per distinct cost is put in order; a row stays if it is the best of its cost and better
    than all cheaper ones.
    """
    best = rows.groupBy(F.col(cost).alias("_c")).agg(F.max(good).alias("_g"))
    cheaper = F.max("_g").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", cheaper).where(F.col("_before").isNull() | (F.col("_g") > F.col("_before")))
    return rows.join(front, (F.col(cost) == F.col("_c")) & (F.col(good) == F.col("_g")), "left_semi")


def against_baseline(rows: DataFrame, baseline: Column) -> DataFrame:
    """Each setting's gain in true links and macro F0.5 and its share of time, against the one baseline row."""
    base = rows.where(baseline).select(F.col("found").alias("_found"), F.col("macro_f05").alias("_f"), F.col("seconds").alias("_s")).limit(1)
    return rows.join(F.broadcast(base)).select(
        *rows.columns, (F.col("found") - F.col("_found")).alias("extra_true_retrieved"), (F.col("macro_f05") - F.col("_f")).alias("macro_f05_change"), (F.col("seconds") / F.col("_s")).alias("time_ratio")
    )


def recall_table(rows: DataFrame, settings: tuple[int, ...]) -> DataFrame:
    return rows.groupBy("nprobe").pivot("overfetch", list(settings)).agg(F.first("recall"))

"""Counts, macro F0.5, recall reports, threshold tuning, slices and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT_NONE = 1.000001


def threshold_grid(kind: str = "wide") -> list[float]:
    """``wide``: 0.05 to 0.95 in steps of 0.025 and five high ones; ``fine``: the same range in steps of 0.01; ``percent``: 0.01 to 0.99."""
    high = [0.97, 0.99, 0.995, 0.999, ACCEPT_NONE]
    if kind == "wide":
        return [round(0.05 + 0.025 * i, 3) for i in range(37)] + high
    if kind == "fine":
        return [round(0.05 + 0.01 * i, 2) for i in range(91)]
    if kind == "percent":
        return [round(0.01 * i, 2) for i in range(1, 100)]
    raise ValueError(kind)


def per_business(counts: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Predicted and correct pairs of every record of source 1, zero where there are none.

    ``counts`` has ``s1`` and ``n_true``; ``pairs`` the accepted pairs with ``label``. With ``by``
    (as a threshold) ``counts`` holds those columns too.
    """
    sums = pairs.groupBy("s1", *by).agg(F.count("label").alias("n_pred"), F.sum("label").alias("n_hit"))
    return counts.join(sums, ["s1", *by], "left").withColumns({"n_pred": F.coalesce("n_pred", F.lit(0)), "n_hit": F.coalesce("n_hit", F.lit(0))})


def f05() -> Column:
    """1.25 TP / (1.25 TP + FP + 0.25 FN); a record without true targets scores 1 if nothing is predicted, else 0."""
    hit, wrong, missed = F.col("n_hit"), F.col("n_pred") - F.col("n_hit"), F.col("n_true") - F.col("n_hit")
    below = 1.25 * hit + wrong + 0.25 * missed
    return F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(F.when(below > 0, 1.25 * hit / below).otherwise(0.0))


def macro(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    lonely = F.col("n_true") == 0
    return rows.groupBy(*by).agg(
        F.avg(f05()).alias("macro_f05"),
        F.sum("n_hit").alias("correct"),
        F.sum(F.col("n_pred") - F.col("n_hit")).alias("incorrect"),
        F.sum(F.col("n_true") - F.col("n_hit")).alias("missed"),
        F.sum(lonely.cast("long")).alias("singletons"),
        F.sum((lonely & (F.col("n_pred") == 0)).cast("long")).alias("singletons_correct"),
    )


def tune(counts: DataFrame, scored: DataFrame, grid: list[float]) -> DataFrame:
    """Macro F0.5 at each threshold of the grid (a stated list, so no join of two tables)."""
    values = F.explode(F.array(*[F.lit(float(t)) for t in grid]))
    all_counts = counts.withColumn("threshold", values)
    accepted = scored.withColumn("threshold", values).where("score >= threshold")
    return macro(per_business(all_counts, accepted, ("threshold",)), ("threshold",))


def best_threshold(tuned: DataFrame) -> DataFrame:
    """The row of the largest macro F0.5; of equals the one of the higher threshold."""
    best = tuned.agg(F.max(F.struct(F.col("macro_f05"), F.col("threshold"))).alias("m"))
    return best.select("m.threshold", "m.macro_f05")


def compare_by_country(counts: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """Macro F0.5 of each country by each model (accepted pairs with ``label``), with the change against the first.

    ``counts`` has ``s1``, ``n_true`` and ``country``.
    """
    names = list(models)
    first = macro(per_business(counts, models[names[0]]), ("country",)).select("country", F.col("macro_f05").alias("_first"))
    out = None
    for name in names:
        part = macro(per_business(counts, models[name]), ("country",)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(first, "country").withColumn("change", F.col("macro_f05") - F.col("_first")).drop("_first")


def recall_report(counts: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (10, 20, 50), by: tuple[str, ...] = ()) -> DataFrame:
    """Found links, recall (1 without true links) and sizes of the lists cut at each k."""
    each = F.explode(F.array(*[F.lit(k) for k in ks]))
    rows = per_business(counts.withColumn("k", each), ranked.withColumn("k", each).where("rank <= k"), ("k",))
    total = F.sum("n_true")
    return rows.groupBy(*by, "k").agg(
        F.sum("n_hit").alias("found"),
        total.alias("true_links"),
        F.when(total > 0, F.sum("n_hit") / total).otherwise(1.0).alias("recall"),
        F.avg("n_pred").alias("mean_size"),
        F.percentile("n_pred", F.lit(0.95)).alias("p95_size"),
        F.max("n_pred").alias("max_size"),
    )


def retrieval_detail(counts: DataFrame, truth: DataFrame, candidates: DataFrame, exact: DataFrame) -> DataFrame:
    """Per record of source 1: candidates, found links, and those that exact keys had missed."""

    def ids(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.groupBy("s1").agg(F.collect_set(col).alias(name))

    empty = F.array().cast("array<string>")
    rows = counts.join(ids(truth, "target", "truth"), "s1", "left").join(ids(candidates, "cand", "found"), "s1", "left").join(ids(exact, "cand", "exact"), "s1", "left")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("truth", "found", "exact")})
    hit = F.array_intersect("found", "truth")
    return rows.select(
        "s1", "n_true",
        F.size("found").alias("candidates"),
        F.size(hit).alias("hits"),
        F.size(F.array_except(hit, F.col("exact"))).alias("recovered"),
        F.size(F.array_except("truth", "found")).alias("missed"),
    )


def retrieval_summary(detail: DataFrame) -> DataFrame:
    lonely = F.col("n_true") == 0
    return detail.agg(
        (F.sum("hits") / F.greatest(F.sum("n_true"), F.lit(1))).alias("link_recall"),
        F.avg(F.when(~lonely, F.col("hits") / F.col("n_true"))).alias("macro_recall"),
        F.avg("candidates").alias("mean_candidates"),
        F.percentile("candidates", F.lit(0.95)).alias("p95_candidates"),
        F.max("candidates").alias("max_candidates"),
        F.sum("recovered").alias("recovered_over_exact"),
        F.sum((~lonely & (F.col("hits") == F.col("n_true"))).cast("long")).alias("all_retrieved"),
        F.sum(lonely.cast("long")).alias("singletons"),
    )


def miss_split(truth: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """True links that the search missed, that the classifier rejected, and that were accepted."""
    joined = truth.join(scored.select("s1", F.col("cand").alias("target"), "score"), ["s1", "target"], "left")
    status = F.when(F.col("score").isNull(), "missed_by_search").when(F.col("score") < threshold, "retrieved_but_rejected").otherwise("accepted")
    return joined.groupBy(status.alias("status")).agg(F.count("s1").alias("links"))


def size_histogram(counts: DataFrame, pairs: DataFrame, top: int = 20) -> DataFrame:
    """Number of records by candidate count, every size from 0 to ``top`` present."""
    sizes = per_business(counts, pairs.withColumn("label", F.lit(0))).groupBy(F.least(F.col("n_pred"), F.lit(top)).cast("long").alias("size")).agg(F.count("s1").alias("n"))
    every = pairs.sparkSession.range(top + 1).select(F.col("id").alias("size"))
    return every.join(sizes, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Sizes of groups, null groups too, largest first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def slice_report(truth: DataFrame, scored: DataFrame, blank: DataFrame, threshold: float) -> DataFrame:
    """True, retrieved and accepted links, and recall, for targets with and without an address (``blank``: ``target``)."""
    rows = truth.join(blank.select("target", F.lit(True).alias("blank")), "target", "left").join(scored.select("s1", F.col("cand").alias("target"), "score"), ["s1", "target"], "left")
    return rows.groupBy(F.coalesce("blank", F.lit(False)).alias("address_missing")).agg(
        F.count("s1").alias("true_links"),
        F.count("score").alias("retrieved"),
        F.sum((F.coalesce("score", F.lit(-1.0)) >= threshold).cast("long")).alias("accepted"),
        (F.count("score") / F.count("s1")).alias("recall"),
    )


def pair_audit(scopes: dict[str, DataFrame]) -> DataFrame:
    """Pairs, positives and negatives by scope and missing address."""
    parts = [
        df.groupBy(F.lit(name).alias("scope"), (F.col("address_missing") > 0).alias("address_missing")).agg(
            F.count("label").alias("pairs"), F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives")
        )
        for name, df in scopes.items()
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def summary(counts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows, candidate pairs, predicted links and how many records have none."""
    accepted = F.col("score") >= threshold
    sums = pairs.groupBy("s1").agg(F.count("score").alias("c"), F.sum(accepted.cast("long")).alias("m"))
    rows = counts.select("s1").join(sums, "s1", "left").select(F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("m", F.lit(0)).alias("m"))
    return rows.agg(
        F.count("c").alias("rows"), F.sum("c").alias("candidate_pairs"), F.sum("m").alias("predicted_links"),
        F.sum((F.col("c") == 0).cast("long")).alias("empty_candidates"), F.sum((F.col("m") == 0).cast("long")).alias("empty_matches"), F.avg("c").alias("mean_candidates"),
    )


def violations(s1: DataFrame, results: DataFrame, records: DataFrame, most: int | None = None, every: bool = False) -> DataFrame:
    """Broken rules of exported lists: ``rule`` and ``n``, no rows if all is well (with ``every`` all rules).

    One row per record of source 1; matches are candidates; candidates are distinct records of other
    sources, of the same country, and at most ``most``.
    """
    ids = s1.select(F.col("entity_id").alias("s1"))
    flat = results.select("s1", F.explode("candidates").alias("cand"))
    known = flat.join(records.select(F.col("entity_id").alias("cand"), "source", F.col("country").alias("there")), "cand", "left")
    known = known.join(s1.select(F.col("entity_id").alias("s1"), F.col("country").alias("here")), "s1", "left")
    rules = {
        "missing_row": ids.join(results, "s1", "left_anti"),
        "unknown_row": results.join(ids, "s1", "left_anti"),
        "repeated_row": results.groupBy("s1").count().where("count > 1"),
        "match_not_candidate": results.where(F.size(F.array_except("matches", "candidates")) > 0),
        "repeated_candidate": results.where(F.size(F.array_distinct("candidates")) < F.size("candidates")),
        "wrong_source": known.where("source is null or source = 1"),
        "wrong_country": known.where("here <> there"),
    }
    if most is not None:
        rules["too_many"] = results.where(F.size("candidates") > most)
    out = None
    for rule, df in rules.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out if every else out.where("n > 0")

"""The pipelines as plans: block keys or neighbour search, features, scores, lists; and the fit-tune-evaluate path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.functions import text as X
from entlink.operators import evaluation as E
from entlink.operators import knn as N
from entlink.operators.blocking import MAX_BLOCK, block_candidates, prepared
from entlink.operators.encoder import Encoder, encode, encode_pool, encode_records, unpacked, with_bank
from entlink.operators.export import lists
from entlink.operators.features import FEATURES, MATCH_FEATURES, blocked_features, compact, fixed_score, labelled, pair_features, with_cosine
from entlink.operators.matching import BASELINE, EMBEDDING, Matcher, tuned
from entlink.operators.sampling import stratified_split
from entlink.sources.records import with_dense_id
from entlink.sources.scratch import drop, packed, released, stage

THRESHOLD = 0.7
KEPT = 20  # candidates of a record that the search keeps
RESCUED = 5  # more candidates by name alone, among records without an address


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepared records of source 1, and of the other sources; prepared once, in the shared folder."""
    prep = stage(prepared(records), "prepared")
    return prep.where("source = 1"), prep.where("source > 1")


def compact_sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``blocked_features`` needs of both sides, in the shared folder."""
    held = stage(compact(prepared(records, grams=False)), "compact")  # packed row by row
    return held.where("source = 1").drop("source"), held.where("source > 1").drop("source")


def featured(records: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Features of the pairs that share a block key."""
    s1, others = sides(records)
    return pair_features(block_candidates(s1, others, max_block), s1, others)


def matched(records: DataFrame, max_block: int = MAX_BLOCK, threshold: float = THRESHOLD, order: str = "id") -> DataFrame:
    """Candidates and matches of every record of source 1 by the fixed score."""
    scored = featured(records, max_block).select("s1", "cand", fixed_score().alias("score"))
    return lists(records.where("source = 1"), scored, threshold, order)


@dataclass
class Search:
    """Numbered queries and pool with their vectors as 16-bit floats, the index, and ``entity_id`` and ``vector`` (floats) of both sides."""

    queries: DataFrame
    pool: DataFrame
    index: N.CellIndex
    vectors: DataFrame

    @classmethod
    def build(cls, records: DataFrame, encoder: Encoder, flat_below: int = N.FLAT_BELOW, vectors_path: str | None = None) -> Search:
        """Encode the pool (sources 2 and 3) into a table, taken up again if it is there, and index it by country."""
        spark = records.sparkSession
        text = ["source", "entity_id", "business_name", "business_address", X.norm(F.col("country")).alias("country")]
        if vectors_path:
            pool = with_dense_id(records.where("source > 1").select(text), ["source", "entity_id"], "rid")
            stored = encode_pool(pool, encoder, vectors_path).select("rid", "entity_id", "country", "vector")
            asked = encode_records(with_dense_id(records.where("source = 1").select(text), ["entity_id"], "q"), encoder, stored=True)
            queries = stage(asked.select("q", "entity_id", "country", "vector"), "queries")
        else:  # encoded before they are numbered, so that texts do not move
            made = packed(encode_records(records.select(text), encoder, stored=True).select("source", "entity_id", "country", "vector"), "encoded")
            stored = with_dense_id(made.where("source > 1"), ["source", "entity_id"], "rid").select("rid", "entity_id", "country", "vector")
            queries = with_dense_id(made.where("source = 1"), ["entity_id"], "q").select("q", "entity_id", "country", "vector")
            drop(made)
        index = N.build_cells(stored.where("country <> ''"), flat_below=flat_below)
        released(spark)
        both = unpacked(queries.select("entity_id", "vector").unionByName(stored.select("entity_id", "vector")))
        return cls(queries, stored, index, both)

    def pairs(self, profile: N.Profile = N.PROFILES["standard"], k: int = KEPT) -> DataFrame:
        """``s1``, ``cand``, ``embedding_cosine``, ``rank``: the ``k`` closest records of the same country."""
        found = N.cell_neighbours(self.queries.where("country <> ''"), self.index, profile, k)
        named = found.join(self.queries.select("q", F.col("entity_id").alias("s1")), "q").join(self.pool.select("rid", F.col("entity_id").alias("cand")), "rid")
        return named.select("s1", "cand", F.col("cosine").alias("embedding_cosine"), "rank")


def name_vectors(records: DataFrame, encoder: Encoder, bank: DataFrame | None = None) -> DataFrame:
    """``entity_id`` and the vector of the record's name alone; each distinct name is encoded once, or taken from the bank."""
    named = records.select("entity_id", F.concat(F.lit("query: "), X.clean_text(F.col("business_name"))).alias("name"))
    known = bank if bank is not None else encode(records.sparkSession.createDataFrame([], "name string"), encoder, "name")
    return stage(named.join(with_bank(named, known, encoder), "name").select("entity_id", "vector"), "names")


def rescued(records: DataFrame, names: DataFrame, k: int = RESCUED) -> DataFrame:
    """``s1``, ``cand``, ``name_rank``: for each record of source 1 the ``k`` closest by name among the records without an address.

    The search is exact, within the country.
    """
    spare = records.select("source", "entity_id", "business_address", X.norm(F.col("country")).alias("country")).where("country <> ''").join(names, "entity_id")
    pool = with_dense_id(spare.where((F.col("source") > 1) & X.is_blank(F.col("business_address"))), ["entity_id"], "rid")
    queries = with_dense_id(spare.where("source = 1"), ["entity_id"], "q")
    found = N.exact_neighbours(queries.select("country", "q", "vector"), pool.select("country", "rid", "vector"), k)
    named = found.join(queries.select("q", F.col("entity_id").alias("s1")), "q").join(pool.select("rid", F.col("entity_id").alias("cand")), "rid")
    return named.select("s1", "cand", F.col("rank").alias("name_rank"))


def rescue_features(records: DataFrame, search: Search, encoder: Encoder, profile: N.Profile = N.PROFILES["standard"]) -> DataFrame:
    """All pairs of the search and the rescue by name, with ``in_baseline``, the features and both cosines."""
    names = name_vectors(records, encoder)
    base = search.pairs(profile).select("s1", "cand", F.lit(True).alias("in_baseline"))
    more = rescued(records, names).select("s1", "cand")
    both = stage(base.join(more, ["s1", "cand"], "outer").withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False))), "both")
    s1, others = sides(records)
    return pair_features(with_cosine(with_cosine(both, search.vectors), names, "name_embedding_cosine"), s1, others)


def embedding_features(records: DataFrame, search: Search, profile: N.Profile = N.PROFILES["standard"], k: int = KEPT) -> DataFrame:
    """``embedding_cosine``, ``rank`` and features of the pairs that the search finds."""
    return _featured(search.pairs(profile, k), records)


def _featured(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Features of narrow pairs that have all else by now, so that no row of features is joined again."""
    pairs = stage(pairs, "found")
    released(records.sparkSession)
    return blocked_features(pairs, *compact_sides(records))


def embedding_matched(records: DataFrame, truth: DataFrame, counts: DataFrame, encoder: Encoder, profile: N.Profile = N.PROFILES["standard"], flat_below: int = N.FLAT_BELOW, threshold: float | None = THRESHOLD, **settings: int) -> tuple[Matcher, DataFrame]:
    """The selected pipeline: encode, search cells, nineteen features, trees, cutoff, lists of at most 20 by falling score.

    The trees learn from the train split of the records of source 1. Without ``threshold`` it is
    tuned on the tune split. ``counts``: ``s1``, ``n_true``.
    """
    search = Search.build(records, encoder, flat_below)
    split = splits(counts, records)
    pairs = labelled(search.pairs(profile), truth).join(split.select("s1", "split"), "s1")
    ready = packed(_featured(pairs, records), "ready")
    released(records.sparkSession)
    matcher, _ = fit_and_tune(ready, split, MATCH_FEATURES, **(EMBEDDING | settings))
    scored = matcher.score(ready).select("s1", "cand", "score")
    return matcher, lists(records.where("source = 1"), scored, matcher.threshold if threshold is None else threshold, "rank")


def ablation(search: Search, records: DataFrame, truth: DataFrame, counts: DataFrame, split: DataFrame, seed: int = 83, k: int = KEPT, **settings: int) -> DataFrame:
    """Every ``nprobe`` with every ``overfetch`` of the profiles, in random order, the standard setting before and after them.

    ``run`` (the order), ``nprobe``, ``overfetch``, ``found``, ``recall`` of true links at ``k``, ``macro_f05`` of one
    model, fitted and tuned on the pairs of the standard setting, and ``seconds`` of the search, summed over its tasks
    (``cell_runs``). Features are made once for the pairs of all runs.
    """
    grid = [N.Profile(p, o) for p in sorted(x.nprobe for x in N.PROFILES.values()) for o in sorted(x.overfetch for x in N.PROFILES.values())]
    standard = N.PROFILES["standard"]
    profiles = [standard, *[grid[i] for i in np.random.default_rng(seed).permutation(len(grid))], standard]
    runs = stage(N.cell_runs(search.queries.where("country <> ''"), search.index, profiles, k), "runs")
    took = {r.run: r.seconds for r in runs.where("q is null").groupBy(F.get("runs", F.lit(0)).alias("run")).agg(F.sum("cosine").alias("seconds")).collect()}
    named = runs.where("q is not null").withColumnRenamed("cosine", "embedding_cosine").join(search.queries.select("q", F.col("entity_id").alias("s1")), "q").join(search.pool.select("rid", F.col("entity_id").alias("cand")), "rid").select("s1", "cand", "embedding_cosine", "runs")
    ready = packed(_featured(labelled(named, truth).join(split.select("s1", "split"), "s1"), records), "ready")
    released(records.sparkSession)
    matcher, _ = fit_and_tune(ready.where(F.array_contains("runs", 0)), split, MATCH_FEATURES, **(EMBEDDING | settings))
    scored = stage(matcher.score(ready).select(F.explode("runs").alias("run"), "s1", "cand", "label", "score"), "scored")
    each = counts.select("s1", "n_true", F.explode(F.sequence(F.lit(0), F.lit(len(profiles) - 1))).alias("run"))
    found = E.per_business(each, scored, ("run",)).groupBy("run").agg(F.sum("n_hit").alias("found"), F.when(F.sum("n_true") > 0, F.sum("n_hit") / F.sum("n_true")).otherwise(1.0).alias("recall"))
    quality = E.macro(E.per_business(each, scored.where(F.col("score") >= matcher.threshold), ("run",)), ("run",)).select("run", "macro_f05")
    told = records.sparkSession.createDataFrame([(i, p.nprobe, p.overfetch, float(took.get(i, 0.0))) for i, p in enumerate(profiles)], "run int, nprobe int, overfetch int, seconds double")
    return told.join(found, "run").join(quality, "run").select("run", "nprobe", "overfetch", "found", "recall", "macro_f05", "seconds")


def splits(counts: DataFrame, records: DataFrame) -> DataFrame:
    """``s1``, ``n_true``, ``country`` and ``split`` of every record of source 1, stratified by country and whether it stands alone."""
    countries = records.where("source = 1").select(F.col("entity_id").alias("s1"), "country")
    rows = counts.select("s1", "n_true").join(countries, "s1").withColumn("lonely", F.col("n_true") == 0)
    return stage(stratified_split(rows, ["country", "lonely"], id_col="s1").select("s1", "n_true", "country", "split"), "split")


def fit_and_tune(ready: DataFrame, split: DataFrame, features: tuple[str, ...], grid: str = "fine", **settings: int) -> tuple[Matcher, DataFrame]:
    """Fit on the train split and choose the threshold on the tune split; the scored held-out pairs are returned too."""
    pairs = ready if "split" in ready.columns else ready.join(split.select("s1", "split"), "s1")
    matcher = Matcher.fit(pairs.where("split = 'train'"), features, **settings)
    held = matcher.score(pairs.where("split <> 'train'")).select("s1", "cand", "label", "split", "score")
    tuned(matcher, split.where("split = 'tune'").select("s1", "n_true"), held.where("split = 'tune'"), E.threshold_grid(grid))
    return matcher, held


def fit_and_evaluate(pairs: DataFrame, truth: DataFrame, counts: DataFrame, countries: DataFrame, features: tuple[str, ...] = FEATURES, grid: str = "fine", **settings: int) -> tuple[Matcher, DataFrame]:
    """Fit on the train split, choose the threshold on the tune split, read the evaluation split once.

    ``pairs`` has the features, ``counts`` (``s1``, ``n_true``) every record, ``countries`` their country.
    """
    rows = counts.join(countries, "s1").withColumn("lonely", F.col("n_true") == 0)
    split = stage(stratified_split(rows, ["country", "lonely"], id_col="s1").select("s1", "n_true", "split"), "split")
    matcher, held = fit_and_tune(stage(labelled(pairs, truth), "ready"), split, features, grid, **(BASELINE | settings))
    final = held.where((F.col("split") == "evaluation") & (F.col("score") >= matcher.threshold))
    return matcher, E.macro(E.per_business(split.where("split = 'evaluation'").select("s1", "n_true"), final))

"""Candidate pairs from shared block keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entlink.functions import text as X

MAX_BLOCK = 30
HOT = 100_000  # rows of a key that one task joins


def prepared(records: DataFrame, grams: bool = True) -> DataFrame:
    """All that keys and features need; to be staged, so that it is made once per record and before any join of pairs.

    Without ``grams``: all but the trigrams.
    """
    base = records.withColumns({"_n": X.fold(F.col("business_name")), "_a": X.fold(F.col("business_address")), "_c": X.fold(F.col("country"))})
    base = base.withColumns({"name_words": X.words(F.col("_n")), "addr_words": X.address_words(F.col("_a")), "country_norm": F.array_join(X.words(F.col("_c")), " ")})
    base = base.withColumns({"name_norm": F.array_join("name_words", " "), "addr_norm": F.array_join("addr_words", " "), "core": X.core_words(F.col("name_words")), "unit": X.unit_id(F.col("_a"))})
    base = base.withColumns({
        "numbers": X.number_words(F.col("addr_norm")),
        "name_set": F.array_distinct("name_words"),
        "addr_set": F.array_distinct("addr_words"),
    }).drop("_n", "_a", "_c")
    return base.withColumns({f"{c}_grams": X.grams(F.col(f"{c}_norm")) for c in ("name", "addr")}) if grams else base


def block_keys() -> Column:
    """Array of keys of a prepared record: core name, plain name, sorted address, name word with numbers."""
    country, core, joined = F.col("country_norm"), F.col("core"), F.array_join("core", "")
    plain = F.replace(F.col("name_norm"), F.lit(" "), F.lit(""))
    long_words = F.transform(F.filter(core, lambda t: F.length(t) >= 4), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    word = F.get(F.array_sort(long_words), F.lit(0))["t"]
    numbers = F.slice(F.array_sort("numbers"), 1, 3)
    keys = F.concat(
        F.array(
            F.when(F.length(joined) >= 5, F.concat(country, F.lit("|N|"), joined)),
            F.when(F.length(plain) >= 5, F.concat(country, F.lit("|R|"), plain)),
            F.when((F.length("addr_norm") >= 12) & (F.size("addr_words") >= 3), F.concat(country, F.lit("|A|"), F.array_join(F.array_sort("addr_words"), " "))),
        ),
        F.transform(numbers, lambda x: F.concat(country, F.lit("|P|"), word, F.lit("|"), x)),
    )
    return F.when(country != "", F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).otherwise(F.array().cast("array<string>"))


def keyed(prep: DataFrame, id_col: str = "entity_id") -> DataFrame:
    return prep.select(id_col, "country_norm", F.explode(block_keys()).alias("key"))


def block_index(keys: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Keys of source 1 that at most ``max_block`` of its records have; broader keys go as a whole."""
    counts = keys.groupBy("key").agg(F.count("key").alias("n"))
    return keys.join(counts.where(F.col("n") <= max_block), "key").drop("n")


def candidate_pairs(index: DataFrame, keys: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct pairs ``s1``, ``cand`` that share a key (compared as text) and their country.

    The cap bounds a key's owners in ``index`` and not its rows in ``keys``. A key with more than
    ``hot`` of those is dealt to several parts by a hash of their id, and its few owners go to each
    part. At most one key in ``hot`` rows is such a key, so their table is small.
    """
    sizes = keys.groupBy("key").agg(F.count("key").alias("n")).where(F.col("n") > hot)
    parts = F.broadcast(sizes.select("key", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    left = index.select(F.col("entity_id").alias("s1"), "country_norm", "key").join(parts, "key", "left")
    left = left.select("s1", "country_norm", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    right = keys.select(F.col("entity_id").alias("cand"), "country_norm", "key").join(parts, "key", "left")
    right = right.select("cand", "country_norm", "key", F.pmod(F.xxhash64("cand"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return left.join(right, ["key", "country_norm", "part"]).select("s1", "cand").distinct()


def block_candidates(s1: DataFrame, others: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Pairs of prepared records."""
    return candidate_pairs(block_index(keyed(s1), max_block), keyed(others))

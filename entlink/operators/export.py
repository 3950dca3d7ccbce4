"""Lists per record of source 1: shards with checks, import by country, and order of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.functions.text import format_list, parse_list
from entlink.sources.scratch import exists, listed, write_json

SHARD = 2000  # rows of a shard
MOST = 20  # candidates of a record


def lists(s1: DataFrame, scored: DataFrame, threshold: float, order: str = "id") -> DataFrame:
    """``ord``, ``s1``, ``candidates`` and ``matches`` (arrays) for every record, empty ones included.

    ``order``: ``id`` sorts by id, ``rank`` by falling score and then id.
    """
    key = F.struct(F.col("cand").alias("k"), F.col("cand"), F.col("score")) if order == "id" else F.struct((-F.col("score")).alias("k"), F.col("cand"), F.col("score"))
    grouped = scored.groupBy("s1").agg(F.array_sort(F.collect_list(key)).alias("items"))
    rows = s1.select("ord", F.col("entity_id").alias("s1")).join(grouped, "s1", "left")
    items = F.coalesce("items", F.array().cast(grouped.schema["items"].dataType))
    return rows.select("ord", "s1", F.transform(items, lambda x: x["cand"]).alias("candidates"), F.transform(F.filter(items, lambda x: x["score"] >= threshold), lambda x: x["cand"]).alias("matches"))


def as_text(rows: DataFrame) -> DataFrame:
    return rows.select("ord", "s1", format_list(F.col("candidates")).alias("candidates"), format_list(F.col("matches")).alias("matches"))


def shard_stats(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """Rows, pairs and links of each run of ``size`` places."""
    return rows.groupBy(F.floor(F.col("place") / size).alias("shard")).agg(
        F.count("s1").alias("rows"), F.sum(F.size("candidates")).alias("candidate_pairs"), F.sum(F.size("matches")).alias("predicted_links"), F.min("place").alias("first"), F.max("place").alias("last")
    )


def _two(path: str) -> tuple[str, str, str]:
    return f"{path}/candidates", f"{path}/matches", f"{path}/stats"


def write_shards(rows: DataFrame, path: str, size: int = SHARD) -> None:
    """Candidates and matches as tab-separated files, a folder for each run of ``size`` places, and a table of their statistics.

    ``rows`` has ``place`` (gapless from 0), ``s1`` and both lists. Statistics come last, so a shard
    counts as written only with them; a run that was cut off writes the shards without statistics
    and leaves the others.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("shard", F.floor(F.col("place") / size))
    candidates, matches, stats = _two(path)
    if exists(spark, stats):
        rows = rows.join(spark.read.parquet(stats).select("shard"), "shard", "left_anti")
        if not rows.limit(1).count():
            return
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "place")
    options = {"sep": "\t", "header": True, "emptyValue": "", "partitionOverwriteMode": "dynamic"}
    for where, column in ((candidates, "candidates"), (matches, "matches")):
        ordered.select("shard", "place", "s1", format_list(F.col(column)).alias(column)).write.options(**options).mode("overwrite").partitionBy("shard").csv(where)
    shard_stats(rows, size).write.mode("append").parquet(stats)


def merge_shards(spark: SparkSession, path: str, size: int = SHARD) -> DataFrame:
    """``place``, ``s1``, ``candidates`` and ``matches`` of all shards, after checks.

    Raises if a shard is missing or twice there, if shards do not follow one another without gap,
    if their files have other headers, or if the files' rows differ from the statistics.
    """
    candidates, matches, stats = _two(path)
    told = spark.read.parquet(stats)
    shards = told.agg(F.count("shard"), F.countDistinct("shard"), F.max("shard"), F.sum("rows")).first()
    if shards[0] != shards[1] or shards[0] != (shards[2] if shards[2] is not None else -1) + 1:
        raise ValueError("a shard is missing or repeated")
    wrong = (F.col("first") != F.col("shard") * size) | (F.col("last") - F.col("first") + 1 != F.col("rows")) | ((F.col("rows") != size) & (F.col("shard") != shards[2]))
    if told.where(wrong).limit(1).count():
        raise ValueError("shards do not follow one another")
    parts = []
    for where, column in ((candidates, "candidates"), (matches, "matches")):
        header = spark.read.text(where).where(F.col("value").startswith("place\t")).select("value").distinct().collect()
        if [r[0] for r in header] != [f"place\ts1\t{column}"]:
            raise ValueError("headers differ")
        rows = spark.read.options(sep="\t", header=True, enforceSchema=False).schema(f"place long, s1 string, {column} string, shard long").csv(where)
        counted = rows.groupBy("shard").agg(F.count("s1").alias("n"), F.countDistinct("place").alias("places"))
        if counted.join(told, "shard", "outer").where(~F.coalesce((F.col("n") == F.col("rows")) & (F.col("places") == F.col("rows")), F.lit(False))).limit(1).count():
            raise ValueError(f"the rows of {column} differ from their statistics")
        parts.append(rows.select("place", "s1", parse_list(F.col(column)).alias(column)))
    both = parts[0].join(parts[1].withColumnRenamed("s1", "also"), "place")
    checked = F.when(F.col("s1") == F.col("also"), F.col("s1")).otherwise(F.raise_error(F.lit("candidates and matches are of different records")))
    return both.select("place", checked.alias("s1"), "candidates", "matches")


def write_diagnostics(tuned: DataFrame, held: DataFrame, path: str) -> None:
    """Tab-separated files of the tried thresholds and of the scored pairs outside the train split."""
    options = {"sep": "\t", "header": True, "emptyValue": ""}
    tuned.orderBy("threshold").coalesce(1).write.options(**options).mode("overwrite").csv(f"{path}/thresholds")
    held.where("split <> 'train'").select("s1", "cand", "split", "label", "score").write.options(**options).mode("overwrite").csv(f"{path}/heldout_pair_scores")


def candidate_histogram(rows: DataFrame) -> DataFrame:
    """Number of records by the length of their candidate list."""
    return rows.groupBy(F.size("candidates").cast("long").alias("size")).agg(F.count("s1").alias("n"))


def import_country(rows: DataFrame, s1: DataFrame, country: str, path: str, most: int = MOST) -> None:
    """Take over one country's lists after checks; doing it again replaces that country only.

    ``rows``: ``s1``, ``candidates`` and ``matches``; ``s1``: the country's records (``entity_id``). The
    records must be the same, each once; at most ``most`` candidates, distinct; matches are
    candidates. The country is marked complete once its rows are committed.
    """
    asked = s1.select(F.col("entity_id").alias("s1"))
    if rows.join(asked, "s1", "left_anti").limit(1).count() or asked.join(rows, "s1", "left_anti").limit(1).count() or rows.groupBy("s1").count().where("count > 1").limit(1).count():
        raise ValueError(f"{country}: the records differ")
    bad = (F.size("candidates") > most) | (F.size(F.array_distinct("candidates")) < F.size("candidates")) | (F.size(F.array_except("matches", "candidates")) > 0)
    if rows.where(bad).limit(1).count():
        raise ValueError(f"{country}: a list breaks the rules")
    rows.select("s1", "candidates", "matches", F.lit(country).alias("country")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("country").parquet(f"{path}/rows")
    write_json(rows.sparkSession, {"country": country, "rows": rows.count()}, f"{path}/complete/{country.encode().hex() or 'none'}.json")


def completed(spark: SparkSession, path: str) -> list[str]:
    """The countries that were taken over whole."""
    return sorted(bytes.fromhex(n.rpartition("/")[2].removesuffix(".json").replace("none", "")).decode() for n in listed(spark, f"{path}/complete") if n.endswith(".json"))


def in_input_order(spark: SparkSession, path: str, s1: DataFrame) -> DataFrame:
    """All imported rows with the place ``ord`` of their record; raises unless every record has one row."""
    rows = spark.read.parquet(f"{path}/rows").select("s1", "candidates", "matches")
    out = s1.select("ord", F.col("entity_id").alias("s1")).join(rows, "s1")
    if out.count() != s1.count() or rows.count() != s1.count():
        raise ValueError("records and rows differ in number")
    return out.select("ord", "s1", "candidates", "matches").orderBy("ord")

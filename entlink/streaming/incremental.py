"""Sources 2 and 3 as streams of files against the fixed key index of source 1."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from entlink.operators.blocking import candidate_pairs, keyed, prepared
from entlink.operators.features import fixed_score, pair_features
from entlink.sources.scratch import exists, read_text, stage, write_text


def guard_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Refuse to go on with a run that other settings began; a new run records its own."""
    mine = json.dumps(settings, sort_keys=True)
    if exists(spark, path):
        if read_text(spark, path).strip() != mine:
            raise ValueError("the run was begun with other settings")
    else:
        write_text(spark, mine, path)


def score_batch(batch: DataFrame, s1: DataFrame, index: DataFrame) -> DataFrame:
    """Scored candidate pairs of a batch of records."""
    others = stage(prepared(batch), "batch")
    pairs = candidate_pairs(index, keyed(others))
    return pair_features(pairs, s1, others).select("s1", "cand", fixed_score().alias("score"))


def start(
    spark: SparkSession, source: str, schema: StructType, s1: DataFrame, index: DataFrame, out: str, checkpoint: str, files_per_batch: int = 1, settings: dict | None = None
) -> StreamingQuery:
    """Score all files there are, a few at a time, and stop; a later call takes up what is new.

    A batch writes the partition of its own number, so a batch that is run again after a failure
    replaces itself: each file counts once. ``s1`` and ``index`` are tables that stay as they are.
    """
    guard_settings(spark, f"{checkpoint}-settings", settings or {})

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, s1, index).withColumn("batch", F.lit(number)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

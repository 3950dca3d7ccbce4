"""The corpus pipeline: language, near-duplicates, repeated bytes, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it back. Stages
tell rows apart that have a null or the same id; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.llm.common import few, stage, table
from entlink.llm.op3_packing import pack_documents
from entlink.llm.op4_language import UNKNOWN, fit_language_model, identify_language
from entlink.llm.op8_templates import contaminated
from entlink.llm.op9_bagminhash import near_duplicate_classes
from entlink.llm.op10_suffix import remove_repeated_bytes

MIN_LANGUAGE_SCORE = 0.5
BROADCAST_ROWS = 1_000_000  # keys of dropped documents that are broadcast at most (about 24 bytes each)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known with a probability of at least 0.5.

    Null, empty and letterless texts are rejected. If no document tells its language, nothing can
    be learnt and every document is rejected. Each row is judged by its own text.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    scored = identify_language(docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), fit_language_model(docs))
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not in the one column of ``dropped``, which is broadcast if it is small and joined by a shuffle otherwise."""
    dropped = stage(dropped.distinct().toDF("_dropped"), "dropped", files=few(docs.sparkSession))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, key.eqNullSafe(F.col("_dropped")), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, the one with the least id.

    Texts without words are nobody's copy. Rows with a null or repeated id are told apart by a hash
    of id and text, which stands for their id; of rows with the same id and text one stays.
    """
    repeated = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")), "repeated", files=few(spark))
    if not repeated.limit(1).count():
        classes = near_duplicate_classes(docs)
        return _without(docs, F.col("doc_id"), classes.where("doc_id <> class_id").select("doc_id"))
    own = F.when(F.col("_again"), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(F.col("doc_id")).alias("_key")
    rows = stage(docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(*docs.columns, "_again", own), "rows")
    classes = near_duplicate_classes(rows, id_col="_key")
    kept = _without(rows, F.col("_key"), classes.where("doc_id <> class_id").select("doc_id"))
    once = kept.where("_again").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.where("_again is null").select(*docs.columns).unionByName(once.select("row.*"))


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that start in an earlier document too; ``n_chars`` follows the text.

    Every row stays, even one of which nothing is left; a null text becomes an empty one. Rows with
    the same id cut nothing from each other; a null id comes first.
    """
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = remove_repeated_bytes(docs, keep=others)
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[columns[c].alias(c) if c in columns else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item as a template, each row judged by its own text.

    Of rows with the same id and text all go or all stay.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    held = contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, key, held.select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; each row is a document of its own."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_bytes", repeated_bytes),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language models, classes and tokenization have no SQL form; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

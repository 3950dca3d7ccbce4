"""Sources: TSV files of business records, truth files, and record views of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.functions.text import parse_list
from entlink.sources.scratch import packed

COLUMNS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def _tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A quoted field may hold line ends only if some line has an odd number of quotes; without such a
    line the file is read by lines, so that a large one is many tasks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": broken, "enforceSchema": False, "mode": "FAILFAST"}
    raw = spark.read.options(**options).schema(schema).csv(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in schema.names])


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Records of a TSV file (gzip or not), all text; the empty string is the missing value."""
    return _tsv(spark, path, SCHEMA).select(*columns)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``s1`` and ``targets`` (list of trimmed ids; empty: the business stands alone)."""
    rows = _tsv(spark, path, TRUTH_SCHEMA)
    return rows.select(F.col("source1_entity_id").alias("s1"), parse_list(F.col("matched_entity_ids")).alias("targets"))


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.options(sep="\t", header=True, quote='"', escape='"', emptyValue="", compression=compression).mode("overwrite").csv(path)


def pool(sources: dict[int, DataFrame]) -> DataFrame:
    """All sources with their number and a dense ``rid`` in the order of source and id.

    Ranks within hash-free id ranges are added to the counts before them, so no task sees all rows.
    """
    parts = [df.select(F.lit(k).alias("source"), *COLUMNS) for k, df in sorted(sources.items())]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return with_dense_id(both, ["source", "entity_id"], "rid")


def with_dense_id(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A gapless number from 0 in the given order: rank in a range of the sort plus the rows of earlier ranges.

    The ranks are written to the shared folder once, so sizes and rows are of the same ranges. Rows
    that are equal in ``order`` get different numbers.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_local", F.monotonically_increasing_id())
    numbered = packed(numbered.withColumn("_part", F.shiftright("_local", 33)).withColumn("_local", F.col("_local").bitwiseAND((1 << 33) - 1)), "ranks")
    sizes = numbered.groupBy("_part").agg(F.count("_part").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over ``documents``: source by the number of the document's site, name up to the first
    full stop or line end, address all that follows, country the language. Of source 1 the row of
    least id stays among equal texts of a language. ``ord`` is the document's id, ``same`` a digest of
    language and text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and lang is not null")
    group = F.substring("source", 4, 9).cast("int") % 3
    name = F.regexp_extract("text", r"^[^.\n]*", 0)
    rows = docs.select(
        (group + 1).alias("source"),
        F.concat(F.lit("S"), (group + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        name.alias("business_name"),
        F.substr("text", F.length(name) + 1).alias("business_address"),
        F.col("lang").alias("country"),
        F.col("doc_id").alias("ord"),
        F.unhex(F.sha2(F.concat("lang", F.lit("\n"), "text"), 256)).alias("same"),
    )
    firsts = rows.where("source = 1").groupBy("same").agg(F.min("ord").alias("ord")).select("ord")
    return rows.where("source = 1").join(firsts, "ord", "left_semi").unionByName(rows.where("source > 1"), allowMissingColumns=True)


def document_truth(records: DataFrame) -> DataFrame:
    """``s1``, ``target``: records of sources 2 and 3 with the text and language of a record of source 1."""
    one = records.where("source = 1").select("same", F.col("entity_id").alias("s1"))
    return one.join(records.where("source > 1").select("same", F.col("entity_id").alias("target")), "same").select("s1", "target")


def truth_counts(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """Number of true targets of every record of source 1, 0 included."""
    counts = truth.groupBy("s1").agg(F.count("target").alias("n_true"))
    return s1.select(F.col("entity_id").alias("s1")).join(counts, "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true"))


def check_truth(s1: DataFrame, truth: DataFrame, rows: DataFrame | None = None) -> None:
    """Raise unless ids are unique and no target belongs to two records; with ``rows`` (one per record) unless all have one."""
    for df, col, what in ((s1, "entity_id", "a record of source 1 is repeated"), (truth, "target", "a target has two records of source 1")):
        if df.groupBy(col).count().where("count > 1").limit(1).count():
            raise ValueError(what)
    if rows is not None:
        if rows.groupBy("s1").count().where("count > 1").limit(1).count():
            raise ValueError("the truth of a record is repeated")
        if s1.join(rows.select(F.col("s1").alias("entity_id")), "entity_id", "left_anti").limit(1).count():
            raise ValueError("a record of source 1 has no truth")


def preview(records: DataFrame, rows: int = 100_000) -> DataFrame:
    """The first rows in the order of the input."""
    return records.orderBy("ord").limit(rows)


def lookup(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records of the wanted ids; raises if one is missing."""
    if ids.join(records, key, "left_anti").limit(1).count():
        raise KeyError(f"unknown {key}")
    return ids.join(records, key)

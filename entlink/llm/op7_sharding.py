"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row sums of the matrix are the row counts of the input partitions, column sums the sizes of
the shards. Given these sums, the matrix of a uniformly random permutation follows the
multivariate hypergeometric law, so drawing it first and then permuting within partitions and
within shards gives a uniform permutation, with one exchange and exact sizes.

No matrix is held anywhere. The partitions are the leaves of a binary tree; a node splits its
column sums between its halves by one draw with a generator seeded by the node. A task walks
from the root to its own leaf, so a retried task finds the same row of the matrix.

The permutation within a shard orders its rows by random 64-bit keys. Ranges of keys are cells
of a bounded number of bytes, each a task of its own; how many rows each cell gets is counted
before the exchange from the keys alone, so a place in the cell gives a place in the shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, stage, table

_NUMPY_LIMIT = 10**9  # numpy draws only from populations below this
_MOST_CELLS = 1 << 20  # the offsets of all cells are broadcast: 16 MB at most
_NAMES = ("_index", "_cell", "_key")
_CHANGED = "the input changed between two runs; call with stable_input=False"


def _stirling_rest(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n) if n else 0.0)
    x = float(n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where the two are near."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return x * math.log(x / mean) - d if x else mean
    v = d / (x + mean)
    total, power, k = d * v, 2 * x * v, 1
    while True:
        power *= v * v
        k += 2
        more = total + power / k
        if more == total:
            return more
        total = more


def _log_binomial(k: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability of ``k`` in ``n``, to about the precision of a double at any size."""
    if k in (0, n):
        return n * (math.log(q) if k == 0 else math.log(p))
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
    return rest + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(k) - math.log(n - k))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken without replacement; any population size.

    Beyond numpy's limit the law is inverted from its mode outward. The probability there is a quotient of
    binomial ones without cancelling logarithms of factorials, so sums are right to rounding; a
    uniform number beyond the summed mass, once in some 10^10 draws, is drawn anew.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    p, q = draws / total, (total - draws) / total
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    at_mode = math.exp(_log_binomial(mode, good, p, q) + _log_binomial(draws - mode, bad, p, q) - _log_binomial(draws, total, p, q))
    while True:
        up = down = mode
        p_up = p_down = at_mode
        left = rng.random() - at_mode
        if left <= 0:
            return mode
        while (up < high or down > low) and max(p_up, p_down) > 1e-25:
            if up < high:
                p_up *= (good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1))
                up += 1
                left -= p_up
                if left <= 0:
                    return up
            if down > low:
                p_down *= down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1))
                down -= 1
                left -= p_down
                if left <= 0:
                    return down


def split_columns(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of ``draws`` rows fall in each column."""
    out, rest = np.zeros(len(columns), np.int64), int(columns.sum())
    for i, size in enumerate(columns.tolist()):
        if draws == 0:
            break
        out[i] = hypergeometric(rng, size, rest - size, draws)
        draws, rest = draws - int(out[i]), rest - size
    return out


def matrix_row(partition: int, counts: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row ``partition`` of the communication matrix."""
    before, low, high, node = np.concatenate([[0], np.cumsum(counts)]), 0, len(counts), 1
    while high - low > 1:
        mid = (low + high) // 2
        left = split_columns(np.random.default_rng([seed, node]), columns, int(before[mid] - before[low]))
        if partition < mid:
            columns, high, node = left, mid, 2 * node
        else:
            columns, low, node = columns - left, mid, 2 * node + 1
    return columns


def dealer(counts: np.ndarray, sizes: np.ndarray, per: int, seed: int, names: list[str], keep: bool):
    """A function that deals the rows of its partition to cells, ``per`` of them to a shard of given ``sizes``.

    With ``keep`` it adds to each row its place in the input, its cell and its key; otherwise it
    only counts rows by cell. ``counts``: the rows of each partition; other numbers of rows raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        mine = int(counts[part]) if part < len(counts) else 0
        labels = np.repeat(np.arange(len(sizes), dtype=np.int64), matrix_row(part, counts, sizes, seed)) if mine else np.zeros(0, np.int64)
        np.random.default_rng([seed, 0, part]).shuffle(labels)
        keys = np.random.default_rng([seed, 1, part])
        for batch in batches:
            n = batch.num_rows
            if at + n > mine:
                raise RuntimeError(_CHANGED)
            key = keys.integers(0, 1 << 63, n)
            cell = labels[at : at + n] * per + (key >> 31) * per // (1 << 32)
            if keep:
                place = np.arange(at, at + n) | np.int64(part) << np.int64(40)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(cell.astype(np.int32)), pa.array(key)], names=names)
            else:
                distinct, times = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int32)), pa.array(times)], names=names)
            at += n
        if at != mine:
            raise RuntimeError(_CHANGED)

    return run


def shard_uniformly(
    df: DataFrame, shards: int, seed: int = 20260, cell_bytes: int = 16 << 20, stable_input: bool = False
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, gapless from 0) to every row.

    Shard sizes differ by one row at most, the first ones being the larger. The rows of a shard are
    ordered by random keys, in cells of about ``cell_bytes`` (larger where that would make more than
    a million cells), one task each. Counts and bytes of the input partitions are all that the
    driver gets.

    ``stable_input``: the plan gives the same rows in the same order in each partition whenever it
    is run, as a scan of files does; otherwise the input is written to the shared folder first.
    Nulls, repeated rows and any columns pass through; rows are told apart by their place in the
    input, so equal keys are no ties. An empty table gives an empty one. Columns that are named
    ``shard``, ``slot`` or like a helper column raise an error.
    """
    if clash := {"shard", "slot", *_NAMES} & set(df.columns):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    if shards < 1:
        raise ValueError("shards must be positive")
    base = df if stable_input else stage(df, "sharding")
    widths = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in base.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    volume = F.sum(sum(widths, F.lit(0)) + 8 * len(base.columns))
    found = {r[0]: r[1:] for r in base.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), volume).collect()}
    counts = np.array([found.get(i, (0, 0))[0] for i in range(max(found, default=0) + 1)], np.int64)
    total = int(counts.sum())
    sizes = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    per = max(1, min(_MOST_CELLS // shards, -(-sum(int(x[1]) for x in found.values()) // (cell_bytes * shards))))

    narrow = base.select(F.lit(1).alias("one")).mapInArrow(dealer(counts, sizes, per, seed, ["_cell", "n"], False), "_cell int, n long")
    per_cell = stage(narrow.groupBy("_cell").agg(F.sum("n").alias("n")), "cells")
    order = Window.partitionBy(F.expr(f"_cell div {per}")).orderBy("_cell")
    starts = per_cell.select("_cell", (F.sum("n").over(order) - F.col("n")).alias("_start"))
    schema = T.StructType([*base.schema.fields, T.StructField("_index", T.LongType()), T.StructField("_cell", T.IntegerType()), T.StructField("_key", T.LongType())])
    dealt = base.mapInArrow(dealer(counts, sizes, per, seed, [*base.columns, *_NAMES], True), schema).repartitionById(shards * per, F.col("_cell")).sortWithinPartitions("_key", "_index")
    # a partition is one cell, so the row's number in it is its place there
    placed = dealt.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return (
        placed.join(F.broadcast(starts), "_cell")
        .withColumn("slot", F.col("_start") + F.col("_place"))
        .withColumn("shard", F.expr(f"cast(_cell div {per} as int)"))
        .drop(*_NAMES, "_start", "_place")
    )


def op7_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Law ``rows``: whole documents go to 8 shards whose counts are at most one apart.

    The digests come from the texts after the exchange. A null text has 0 bytes, so size 1. Null and
    repeated ids are rows like others.
    """
    docs = table(spark, sf_dir, "documents")
    need(docs, ["doc_id", "text"])
    dealt = shard_uniformly(docs.select("doc_id", "text"), shards, stable_input=True)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

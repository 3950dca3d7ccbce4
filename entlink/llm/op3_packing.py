"""Best-fit packing of tokenised documents, with certified bin counts.

Partitions of a bounded number of pieces are packed by best-fit decreasing. Dual feasible functions
give a lower bound of each partition's bins; where it is reached, the partition is certified. The
documents of the partly filled bins of partitions with a gap, and those of the least filled bin of the
others, are exchanged between partitions and packed again, until nothing is left, one partition holds
what is left, or a round saves no bin; such a round's result is dropped for the one before.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, stage, table, text_batches
from .tokens import encoder

CAPACITY = 2048


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The largest of the bounds by dual feasible functions: volume, thresholds, and rounded-up multiples.

    ``times``: how often each of the ``lengths``, then distinct, occurs.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True) if times is None else (np.asarray(lengths, np.int64), times)
    best = -(-int((sizes * counts).sum()) // capacity)
    for eps in {*sizes[sizes * 2 <= capacity].tolist(), capacity // 2}:  # never above half, or two could share a bin
        # 1 above capacity - eps, 0 below eps, else the size itself; scaled by the capacity
        value = np.where(sizes > capacity - eps, capacity, np.where(sizes < eps, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 101):
        # floor((k + 1) x) / k, or x itself where (k + 1) x is whole; scaled by k * capacity
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the level of each bin; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the space left
    levels: list[int] = []
    open_rooms = 0  # bit r: some bin has r left
    sizes = np.asarray(lengths).tolist()
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        n = sizes[i]
        fit = open_rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(levels)
            levels.append(0)
        bins[i], offsets[i] = b, levels[b]
        levels[b] += n
        if not room[r - n]:
            open_rooms |= 1 << (r - n)
        room[r - n].append(b)
    return bins, offsets, np.array(levels, np.int64)


def _pack_group(capacity: int, alone: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, levels = best_fit_decreasing(lengths, capacity)
        reached = len(levels) <= lower_bound(lengths, capacity)
        again = levels < capacity
        if alone:
            again[:] = False
        elif reached:
            again &= np.arange(len(levels)) == np.argmin(levels)
        # without one of its bins a least packing is still the least for what is left, and so are full bins
        proven = reached | (levels == capacity)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "length": lengths, "part": pdf["part"].to_numpy(), "bin": bins, "offset": offsets, "again": again[bins], "certified": proven[bins]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = 20_000) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` to rows with a unique ``key`` (long) and a ``length`` (1 to ``capacity``).

    Pieces that fill a sequence have one to themselves. ``certified``: the sequences that were kept
    together with this one are proven to be as few as can hold their pieces; it is false only for
    what the last round leaves in partitions with a gap. Equal lengths go by key. All columns stay;
    null or other lengths raise an error in the task that meets them; an empty table gives an empty
    one; columns that have one of the added names raise an error. Only counts reach the driver.
    """
    need(pieces, ["key", "length"])
    if clash := {"sequence_id", "offset", "certified"} & set(pieces.columns):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("a piece's length is out of range")))
    narrow = pieces.select("key", checked.cast("int").alias("length"))
    full = narrow.where(F.col("length") == capacity).select("key", F.col("key").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"), F.lit(-1).alias("round"), F.lit(0).alias("part"))
    pool, kept, before = narrow.where(F.col("length") < capacity), [full], None
    left, r = pool.count(), 0
    schema = "key long, length int, part int, bin long, offset long, again boolean, certified boolean"

    def placed(packed: DataFrame, r: int) -> DataFrame:
        return packed.select("key", "bin", "offset", "certified", F.lit(r).alias("round"), "part")

    while left:
        groups = -(-left // group_size)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(groups)).cast("int"))
        packed = stage(dealt.groupBy("part").applyInPandas(_pack_group(capacity, groups == 1), schema), "packed", files=groups)
        first, again = F.col("offset") == 0, F.col("again")
        made, opened, left = packed.agg(F.count_if(first), F.count_if(first & again), F.count_if(again)).first()
        if before is not None and made >= before[1]:
            kept.append(placed(before[0].where("again"), r - 1))
            break
        kept.append(placed(packed.where(~again), r))
        before, pool, r = (packed, opened), packed.where("again").select("key", "length"), r + 1
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    sequence = F.when(F.col("round") < 0, -1 - F.col("bin")).otherwise((F.col("round").cast("long") * (1 << 24) + F.col("part")) * (1 << 24) + F.col("bin"))
    return pieces.join(found.select("key", sequence.alias("sequence_id"), "offset", "certified"), "key")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``sequences``, the lower ``bound`` of any packing of these pieces, and ``uncertified`` sequences.

    The driver gets one row per length, ``capacity`` rows at most. An empty table has 0, 0 and 0.
    """
    lengths = packed.groupBy("length").count().collect()
    bound = lower_bound(np.array([r[0] for r in lengths], np.int64), capacity, np.array([r[1] for r in lengths], np.int64))
    return packed.where("offset = 0").agg(F.count("offset").alias("sequences"), F.lit(bound).cast("long").alias("bound"), F.count_if(~F.col("certified")).alias("uncertified"))


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts, written to the shared folder.

    Columns: ``key`` (unique), ``doc_id``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``
    and, if asked for, ``ids`` (32-bit little-endian). A null or empty text has only the end id.
    Only documents longer than ``capacity`` are cut; their first piece takes what is left over.
    Rows with a null or repeated id are documents of their own, each with pieces from 0; other
    columns are ignored.
    """
    need(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = []
            for ident, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data, enc.dtype)
                n = len(ids) + 1
                wide = np.empty(n, "<u4")
                wide[:-1], wide[-1] = ids, end_id
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = wide[a:b].tobytes()
                    rows.append((ident, k, a, b - a, zlib.crc32(raw), *([raw] * keep_ids)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    made = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)
    return stage(made.withColumn("key", F.monotonically_increasing_id()), "pieces")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_tokens`` and ``ids`` (binary), from pieces with ``ids``."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequences, as ``tokenized_pieces`` and ``pack`` make them."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack(tokenized_pieces(docs, vocabulary))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, end id 0 included, in as few sequences of 2048 tokens as best fit finds."""
    return pack_documents(table(spark, sf_dir, "documents"))

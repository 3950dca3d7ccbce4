"""Token ids of whole texts in wavelet-matrix shards.

A shard holds the ids of consecutive documents. Its distinct ids form a sorted dictionary, and the
places in it are stored as bit planes, the highest bit first; before the next plane the numbers are
sorted stably by the bit, zeros first. With the number of ones before each block of bits, a token at
a place, the count of a token in a range and the place of its k-th occurrence each take one step
per plane, from the stored bytes alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, stage, table, text_batches
from .tokens import encoder

MAGIC = b"WVM1"
_BLOCK = 512  # bits between two stored ranks
_POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """From non-negative ids below 2**32; an empty array is allowed."""
        top = int(ids.max()) + 1 if len(ids) else 0
        if top <= 1 << 22:
            seen = np.zeros(top, bool)
            seen[ids] = True
            alphabet = np.flatnonzero(seen)
            place = np.zeros(top, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
            place[alphabet] = np.arange(len(alphabet))
            codes = place[ids]
        else:
            alphabet, codes = np.unique(ids, return_inverse=True)
        zeros, planes, ranks = [], [], []
        for k in reversed(range(max(1, len(alphabet) - 1).bit_length())):
            bits = (codes & codes.dtype.type(1 << k)) != 0
            ones = codes.compress(bits)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (_BLOCK // 8), np.uint8)])
            per_block = _POPCOUNT[packed].reshape(-1, _BLOCK // 8).sum(1, dtype=np.uint32)
            zeros.append(len(ids) - len(ones))
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            codes = np.concatenate([codes.compress(~bits), ones])
        return cls(len(ids), alphabet.astype("<u4"), zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        parts = [MAGIC, struct.pack("<QIB", self.n, len(self.alphabet), len(self.planes)), self.alphabet.tobytes()]
        for z, plane, rank in zip(self.zeros, self.planes, self.ranks, strict=True):
            parts += [struct.pack("<Q", z), rank.tobytes(), plane.tobytes()]
        body = b"".join(parts)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """Views into ``data``, nothing is decoded. Raises ValueError if a byte has changed."""
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a wavelet shard, or damaged")
        n, sigma, levels = struct.unpack_from("<QIB", data, 4)
        at = 17
        alphabet = np.frombuffer(data, "<u4", sigma, at)
        at += 4 * sigma
        blocks = -(-n // _BLOCK)
        zeros, planes, ranks = [], [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at + 8))
            at += 8 + 4 * (blocks + 1)
            planes.append(np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, at))
            at += blocks * _BLOCK // 8
        return cls(n, alphabet, zeros, planes, ranks)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block, plane = i // _BLOCK, self.planes[level]
        n = int(self.ranks[level][block])
        first, last = block * (_BLOCK // 8), i // 8
        n += int(_POPCOUNT[plane[first:last]].sum())
        return n + (int(plane[last] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` of a plane."""
        ranks, plane, low, high, first = self.ranks[level], self.planes[level], 0, len(self.ranks[level]) - 1, 0
        while high - low > 1:  # the last block before which there are no more than k
            mid = (low + high) // 2
            before = int(ranks[mid]) if bit else mid * _BLOCK - int(ranks[mid])
            if before <= k:
                low, first = mid, before
            else:
                high = mid
        part = np.unpackbits(plane[low * (_BLOCK // 8) : (low + 1) * (_BLOCK // 8)], bitorder="little")
        return low * _BLOCK + int(np.flatnonzero(part == bit)[k - first])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, z in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = z + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (z + a, z + b) if code >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of ``token`` at places from ``low`` to below ``high``."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``; IndexError if there are fewer."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        code, i = int(np.searchsorted(self.alphabet, token)), low + k
        for level in reversed(range(len(self.zeros))):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        for k in range(self.count(token)):
            yield self.select(token, k)

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, the stable sort of each plane is undone."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(codes)
            before[np.flatnonzero(~bits)] = codes[: self.zeros[level]]
            before[np.flatnonzero(bits)] = codes[self.zeros[level] :] | codes.dtype.type(1 << (len(self.planes) - 1 - level))
            codes = before
        return self.alphabet[codes] if self.n else np.zeros(0, "<u4")


_SHARDS = "part int, seq int, part_start long, doc_ids array<long>, lengths array<long>, shard binary"
_SHARD_FIELDS = [("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("shard", pa.binary())]


def wavelet_shards(docs: DataFrame, vocabulary: str, end_id: int | None = 2, shard_tokens: int = 1 << 18, range_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of about ``shard_tokens`` ids, documents in ascending id order, written to the shared folder.

    Each task takes a range of ids with about ``range_bytes`` of text.

    A null text has no ids of its own, only the end id; a null document id comes first; rows that
    repeat an id follow in text order; a longer document has a shard of its own, whole. Other
    columns are ignored. Columns: ``part`` and ``seq`` (the order of shards), ``part_start`` (ids
    of the part before the shard), ``doc_ids``, ``lengths``, ``shard`` (the bytes).
    """
    need(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    ranges = max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // range_bytes))
    ordered = docs.select(F.col(id_col).cast("long"), text_col).repartitionByRange(ranges, id_col).sortWithinPartitions(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        width, ids, lengths, held, seq, start = len(np.zeros(1, enc.dtype).tobytes()), [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start
            joined = np.frombuffer(b"".join(held), enc.dtype)
            row = [part, seq, start, ids[:], lengths[:], WaveletMatrix.build(joined).to_bytes()]
            seq, start = seq + 1, start + len(joined)
            ids.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _SHARD_FIELDS, strict=True)], names=[k for k, _ in _SHARD_FIELDS])

        tokens = 0
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                data += end
                n = len(data) // width
                if ids and tokens + n > shard_tokens:
                    yield flush()
                    tokens = 0
                ids.append(ident), lengths.append(n), held.append(data)
                tokens += n
        if ids:
            yield flush()

    return stage(ordered.mapInArrow(run, _SHARDS), "wavelet")


def decode_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the stored bytes: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (array)."""
    return _read(shards, "ids array<long>", pa.list_(pa.int64()), lambda ids: ids)


def _read(shards: DataFrame, column: str, kind: pa.DataType, of) -> DataFrame:
    # one row per task of the stage that wrote the shards: a bound that the driver itself depends on
    parts = shards.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("base") + F.col("part_start")).alias("start"), "doc_ids", "lengths", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
                ids = WaveletMatrix.from_bytes(batch.column(3)[i].as_buffer().to_pybytes()).decode()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                values = [of(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths), pa.array(values, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", column.split()[0]])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def op1_wavelet(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All texts as wavelet shards with end id 2, read back and digested per document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    shards = wavelet_shards(table(spark, sf_dir, "documents"), vocabulary)
    return _read(shards, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4", copy=False).tobytes()))

"""Finding windows that may repeat across a corpus, losing none: shared by the two exact deduplicators.

Items are the words or bytes of a text. Of each window of items the *anchor* is the shortest-range
sample of its content: the run of ``span`` items with the least hash. Equal windows have equal
anchors at equal places, so a window whose anchor occurs once cannot repeat. Anchors, one in about
fifteen items, are counted by count-min sketches: each block of documents makes a sparse partial
sketch per segment of the hash space, partial sketches of a segment are added up, and each block
gets back which of its anchors are estimated to occur again. Estimates are never too low.

Documents are dealt to blocks by a hash of their id, so each stage finds the same blocks again,
also after the loss of an executor, and a hot source or a large group of copies is spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

# Odd multipliers of the two polynomial hashes and of the finishers: any odd numbers do.
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_M = (0xFF51AFD7ED558CCD, 0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
NULL_ID = -(2**63)  # stands for a null document id; comes first


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64, at least ``n`` of them."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(1 << 16, 1 << (n - 1).bit_length()), []
        for base in (_P[which], pow(_P[which], -1, 2**64)):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[which] = have = (out[0], out[1])
    return have


def mixed(h: np.ndarray, which: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_M[which])
    return h ^ (h >> np.uint64(32))


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """One longer than ``values`` (unsigned 64-bit): sums of values times powers of the multiplier."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, span: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``span`` values."""
    n = len(prefix) - span
    return mixed((prefix[span:] - prefix[:n]) * powers(which, len(prefix))[1][:n], which) if n > 0 else np.zeros(0, np.uint64)


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over each window of ``width`` values."""
    n = 1
    while 2 * n <= width:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def byte_run_hash(data: bytes, span: int) -> np.ndarray:
    """Hash of each run of ``span`` bytes; by words of eight bytes where they make up the span."""
    n = len(data) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if span % 8:
        return run_hash(prefix_hash(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)), span)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    out = words[:n] * np.uint64(_P[0])
    for k in range(8, span, 8):
        out ^= out >> np.uint64(31)
        out *= np.uint64(_M[0])
        out += words[k : k + n]
    return mixed(out, 1)


class Anchors:
    """Anchors of the windows of texts that stand one after another, given the hash of each run of ``span`` items.

    ``sizes`` are the items of each text; windows and so anchors never cross from one into the next.
    """

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, window: int, span: int):
        self.width = window - span + 1  # runs in a window
        self.hashes = (hashes | np.uint64(2)) & ~np.uint64(1)  # never 0; the lowest bit is kept free
        n, windows = len(hashes), max(0, len(hashes) - self.width + 1)
        ends = np.minimum(np.cumsum(sizes)[:-1], windows)
        crossing = np.zeros(windows + 1, np.int32)
        np.add.at(crossing, np.maximum(np.cumsum(sizes)[:-1] - window + 1, 0).clip(max=windows), 1)
        np.add.at(crossing, ends, -1)
        self.inside = np.cumsum(crossing[:-1]) == 0
        if not windows:
            self.places, self.values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        padded = np.zeros(n + self.width - 1, np.uint64)  # windows before the first and after the last
        padded[self.width - 1 : self.width - 1 + windows] = sliding(np.minimum, self.hashes, self.width) * self.inside
        self.places = np.flatnonzero(self.hashes == sliding(np.maximum, padded, self.width)[:n])
        self.values = self.hashes[self.places]

    def candidates(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that have a flagged anchor, and its hash; ``flags`` as ``values``."""
        if not flags.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = self.hashes.copy()
        marked[self.places] |= flags.astype(np.uint64)
        least = sliding(np.minimum, marked, self.width)
        kept = np.flatnonzero((least & np.uint64(1)).astype(bool) & self.inside)
        return kept, least[kept] & ~np.uint64(1)


def grouped(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes each; a longer text stands alone."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))] if sizes else []


def layout(total: int) -> tuple[int, int]:
    """Bytes of a block, and the number of segments, for ``total`` bytes of text.

    A segment stands for about 16 MB of text. Blocks grow with the root of the input, and a
    block has a segment for every 120 bytes at most: so a message holds eight anchors on average
    at least, and the number of messages stays below the number of anchors by that factor.
    """
    block = int(min(64e6, max(2e6, (200 * total) ** 0.5)))
    return block, max(1, min(-(-total // 16_000_000), block // 120))


def blocks_of(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``key`` (block), ``doc_id`` and ``text`` as binary (null: empty), ``rest`` with what is to be kept; and the number of segments."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    block_bytes, segments = layout(total)
    n = max(1, -(-total // block_bytes))
    return docs.select(
        F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(n)).cast("int").alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*keep).alias("rest")] if keep else []),
    ), segments


MESSAGE = "key int, origin int, kind int, n long, a binary, b binary, c binary, d binary"
_NAMES = ["key", "origin", "kind", "n", "a", "b", "c", "d"]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def messages(rows: list[tuple]) -> pa.Table:
    """Rows (key, origin, kind, n, up to four byte strings) as a table of packed arrays."""
    filled = [(*r, *[b""] * (8 - len(r))) for r in rows]
    columns = list(zip(*filled, strict=True)) if filled else [[]] * 8
    trim()
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def segment_of(values: np.ndarray, segments: int) -> np.ndarray:
    """By the bits above the two lowest, which are the same in all anchors."""
    return ((values >> np.uint64(2)) % np.uint64(segments)).astype(np.int64)


def by_segment(values: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``values`` (hashes) by segment and then value, and the bounds of the segments in it."""
    segment = segment_of(values, segments)
    order = np.lexsort((values, segment))
    return order, np.searchsorted(segment[order], np.arange(segments + 1))


def sketch_messages(block: int, values: np.ndarray, counts: np.ndarray, segments: int) -> list[tuple]:
    """A block's sparse partial sketches: per segment, 32-bit keys of its anchors, and their counts."""
    order, bounds = by_segment(values, segments)
    keys = (mixed(values[order], 1) >> np.uint64(32)).astype(np.uint32)
    counts = np.minimum(counts[order], 65_535).astype(np.uint16)
    return [(s, block, 0, b - a, keys[a:b].tobytes(), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]


def merge_sketches(part: pa.Table, hot: int) -> pa.Table:
    """Add up a segment's partial sketches in two rows of counters; answer each with its estimates.

    The answer holds one bit per anchor for "may occur again" and one for "more often than ``hot``".
    The width is four times the keys, so that few are estimated too high.
    """
    keys = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column("a").to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in part.column("b").to_pylist()]
    width = 1 << max(10, (4 * sum(map(len, keys)) - 1).bit_length())
    rows = [np.zeros(width, np.int64), np.zeros(width, np.int64)]

    def cells(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return k & (width - 1), ((k * 0x9E3779B1 + 0x7F4A7C15) >> 13) & (width - 1)

    for k, c in zip(keys, counts, strict=True):
        for row, cell in zip(rows, cells(k), strict=True):
            np.add.at(row, cell, c)
    out = []
    for block, segment, k in zip(part.column("origin").to_pylist(), part.column("key").to_pylist(), keys, strict=True):
        estimate = np.minimum(*(row[cell] for row, cell in zip(rows, cells(k), strict=True)))
        out.append((block, segment, 1, len(k), np.packbits(estimate > 1).tobytes(), np.packbits(estimate > hot).tobytes()))
    return messages(out)


def answers(values: np.ndarray, segments: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct ``values`` of a block: may occur again, and is hot."""
    order, bounds = by_segment(values, segments)
    again, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for kind, s, n, a, b in zip(*(replies.column(c).to_pylist() for c in ("kind", "origin", "n", "a", "b")), strict=True):
        if kind == 1:
            at = order[bounds[s] : bounds[s + 1]]
            if len(at) != n:
                raise RuntimeError("a block changed between two stages")
            again[at] = np.unpackbits(np.frombuffer(a, np.uint8), count=n)
            hot[at] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
    return again, hot


def documents_of(part: pa.Table) -> list[tuple[int, bytes]]:
    """Documents of a block by id; rows that repeat an id by text."""
    return sorted(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True))


def rests_of(part: pa.Table) -> pa.Array:
    """What is kept of the documents, in the order of ``documents_of``; rows with the same id and text by place."""
    ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
    return part.column("rest").combine_chunks().take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))))

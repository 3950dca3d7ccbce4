"""Removal of repeated word windows: count-min prefilter, then exact groups of the windows that are left.

A window is a run of consecutive words of one text. Every word that a window covers whose words also
start earlier (in a document of smaller id, or earlier in the same one) is removed. The prefilter of
``repeats`` estimates how often the content of a window occurs, never too low; windows that may
repeat are grouped by 128-bit hashes of the numbers of their words (see ``words``). Each block of documents sends its first
occurrence of each such window to the window's segment, and gets back whether it is the first of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats as R
from .common import need, table, worker_state
from .words import pieces, word_numbers

_TOGETHER = 1 << 19  # bytes of neighbouring texts that are worked on as one array


class Block:
    """The words of a block's documents, and its windows' anchors."""

    def __init__(self, part: pa.Table, window: int):
        worker_state(None, lambda: None)
        self.docs, self.window = R.documents_of(part), window
        span = max(1, (2 * window) // 5)
        self.sizes = np.zeros(len(self.docs), np.int64)  # words of each document
        self.groups = []  # first document, end document, a row of two numbers for each word, anchors
        for a, b in R.grouped([len(x) for _, x in self.docs], _TOGETHER):
            self.sizes[a:b], words = word_numbers([x for _, x in self.docs[a:b]])
            self.groups.append((a, b, words, R.Anchors(R.run_hash(R.prefix_hash(words[:, 0]), span), self.sizes[a:b], window, span)))
        found = [g[3].values for g in self.groups]
        self.values, self.inverse, self.counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def candidates(self, segments: int, replies: pa.Table) -> tuple[np.ndarray, ...]:
        """Windows that may repeat, in the order of documents: document number, place, and two hashes."""
        again, at = R.answers(self.values, segments, replies)[0][self.inverse], 0
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for a, b, words, anchors in self.groups:
            flags, at = again[at : at + len(anchors.values)], at + len(anchors.values)
            places, _ = anchors.candidates(flags)
            if len(places):
                ends = np.cumsum(self.sizes[a:b])
                doc = np.searchsorted(ends, places, "right")
                h = [R.run_hash(R.prefix_hash(words[:, k], k), self.window, k)[places] for k in (0, 1)]
                out.append((doc + a, places - (ends - self.sizes[a:b])[doc], *h))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def first_of_each(self, h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first window of each content, and each window's content number."""
        order = np.lexsort((h1, h0))  # stable: equal contents stay in the order of documents
        new = np.ones(len(order), bool)
        new[1:] = (h0[order[1:]] != h0[order[:-1]]) | (h1[order[1:]] != h1[order[:-1]])
        content = np.empty(len(order), np.int64)
        content[order] = np.cumsum(new) - 1
        return order[new], content


def _send(window: int, segments: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table) -> pa.Table:
        block = Block(part, window)
        return R.messages(R.sketch_messages(key[0].as_py(), block.values, block.counts, segments))

    return run


def _offer(window: int, segments: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(part, window)
        doc, place, h0, h1 = block.candidates(segments, replies)
        first, _ = block.first_of_each(h0, h1)
        ids = np.array([i for i, _ in block.docs], np.int64)
        order, bounds = R.by_segment(h0[first], segments)
        columns = [h0[first][order], h1[first][order], ids[doc[first]][order], place[first][order] + _bases(block)[doc[first]][order]]
        return R.messages([(s, key[0].as_py(), 2, b - a, *(c[a:b].tobytes() for c in columns)) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a])

    return run


def _bases(block: Block) -> np.ndarray:
    """Words in earlier rows with the same id, so that (id, place) is unique."""
    out, last, n = np.zeros(len(block.docs), np.int64), None, 0
    for i, (ident, _) in enumerate(block.docs):
        if ident != last:
            last, n = ident, 0
        out[i] = n
        n += int(block.sizes[i])
    return out


def _judge(part: pa.Table) -> pa.Table:
    """Which of the first occurrences that blocks sent to a segment is the first of all."""
    rows = [[np.frombuffer(x, t) for x in part.column(c).to_pylist()] for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int64), ("d", np.int64))]
    sizes = [len(x) for x in rows[0]]
    h0, h1, ids, places = (np.concatenate(x) for x in rows)
    order = np.lexsort((places, ids, h1, h0))
    new = np.ones(len(order), bool)
    new[1:] = (h0[order[1:]] != h0[order[:-1]]) | (h1[order[1:]] != h1[order[:-1]])
    wins = np.zeros(len(order), bool)
    wins[order[new]] = True
    ends = np.cumsum(sizes)
    return R.messages([(block, segment, 3, n, np.packbits(wins[e - n : e]).tobytes()) for block, segment, n, e in zip(part.column("origin").to_pylist(), part.column("key").to_pylist(), sizes, ends.tolist(), strict=True)])


def _remove(window: int, segments: int, keep_text: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(part, window)
        doc, place, h0, h1 = block.candidates(segments, replies)
        first, content = block.first_of_each(h0, h1)
        order, bounds = R.by_segment(h0[first], segments)
        wins = np.zeros(len(first), bool)
        for kind, s, n, a in zip(*(replies.column(c).to_pylist() for c in ("kind", "origin", "n", "a")), strict=True):
            if kind == 3:
                wins[order[bounds[s] : bounds[s + 1]]] = np.unpackbits(np.frombuffer(a, np.uint8), count=n)
        repeated = np.ones(len(doc), bool)
        repeated[first[wins]] = False
        doc, place = doc[repeated], place[repeated]
        bounds = np.searchsorted(doc, np.arange(len(block.docs) + 1))
        rows = []
        for i, (ident, text) in enumerate(block.docs):
            size = int(block.sizes[i])
            cover = np.zeros(size + 1, np.int64)
            at = place[bounds[i] : bounds[i + 1]]
            cover[at] += 1
            cover[at + window] -= 1
            keep, begin, kept = np.cumsum(cover[:-1]) == 0, 0, []
            for some in map(bytes.split, pieces(text)):
                chosen = some if not len(at) else list(compress(some, keep[begin : begin + len(some)].tolist()))
                if chosen:
                    kept.append(b" ".join(chosen))
                begin += len(some)
            rows.append((ident, size, size - int(keep.sum()), b" ".join(kept)))
        ids = pa.array([None if r[0] == R.NULL_ID else r[0] for r in rows], pa.int64())
        last = pa.array([r[3].decode("utf-8", "replace") if keep_text else hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
        return pa.table([ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), last], names=["doc_id", "n_words", "n_removed", "kept_text" if keep_text else "kept_sha256"])

    return run


def remove_repeated_windows(docs: DataFrame, window: int = 20, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (or its ``kept_sha256``).

    Words end at ASCII white space and are joined by one space in the result. A null or empty text
    has no words; a null id comes before all others; rows that repeat an id count as one document
    after another, in text order. Other columns are ignored. Windows are judged on the input.
    """
    need(docs, [id_col, text_col])
    blocks, segments = R.blocks_of(docs, id_col, text_col)
    grouped = blocks.groupBy("key")
    sketches = grouped.applyInArrow(_send(window, segments), R.MESSAGE)
    estimates = sketches.groupBy("key").applyInArrow(lambda part: R.merge_sketches(part, 1 << 40), R.MESSAGE)
    offers = grouped.cogroup(estimates.groupBy("key")).applyInArrow(_offer(window, segments), R.MESSAGE)
    verdicts = offers.groupBy("key").applyInArrow(_judge, R.MESSAGE)
    last = "kept_text" if keep_text else "kept_sha256"
    return grouped.cogroup(estimates.unionByName(verdicts).groupBy("key")).applyInArrow(_remove(window, segments, keep_text), f"doc_id long, n_words long, n_removed long, {last} string")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words removed from all documents."""
    return remove_repeated_windows(table(spark, sf_dir, "documents"), keep_text=False)

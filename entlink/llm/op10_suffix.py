"""Removal of byte strings that start in an earlier document too, by suffix arrays of difference covers.

The suffixes of the corpus are dealt out by content. ``repeats`` finds the strings that may occur in
two documents; consecutive starts that share an anchor travel together with the bytes they need, to
the part of the suffix array that the anchor names. Equal strings have equal anchors, so they meet
in one part. A part sorts its suffixes by the difference cover modulo 3: the triples at places 1 and 2
modulo 3 are sorted and named, the string of names is sorted in turn until names are unique or cover
the length asked for, and the remaining suffixes are merged in. Neighbours that agree in the whole
length form a class, whose least document id is answered to the documents' blocks.

Each block first puts its own equal texts together, then its equal contexts, so a text of which there
are very many copies is sent once a block.

Anchors that more than ``HOT`` documents share are spread: each of their starts goes by a hash of its
own string, so no part gathers all surroundings of one very common passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import repeats as R
from .common import need, table, worker_state

LENGTH = 50
SPAN = 16  # bytes of an anchor
HOT = 20_000
PARTS = 256  # of a segment, sorted one after another or a few together
TOGETHER = 60_000  # bytes of distinct contexts
GROUP = 1 << 18  # bytes of neighbouring documents whose anchors are found as of one array


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers in the order of tuples, equal for equal tuples, from non-negative columns."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = int(c.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return key


def _sorted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of tuples of non-negative numbers, and for each place of the order whether a new tuple begins.

    Where tuple and index fit into 64 bits, one sort of plain integers does it.
    """
    n = len(columns[0])
    index_bits = max(1, (n - 1).bit_length())
    widths = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    if sum(widths) + index_bits <= 64:
        key = columns[0].astype(np.uint64)
        for c, w in zip(columns[1:], widths[1:], strict=True):
            key = key << np.uint64(w) | c.astype(np.uint64)
        key = np.sort(key << np.uint64(index_bits) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << index_bits) - 1)).astype(np.int64)
        key >>= np.uint64(index_bits)
    else:
        key = _dense(*columns)
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    return order, new


def suffix_order(codes: np.ndarray, enough: int | None = None, cover: int = 1) -> np.ndarray:
    """Starts of all suffixes of ``codes`` (positive integers) in order, by the difference cover modulo 3.

    With ``enough``, suffixes that agree in so many codes may stand in any order; ``cover`` is how
    many codes of the first string one code stands for.
    """
    n = len(codes)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    text = np.concatenate([codes, np.zeros(3, codes.dtype)])
    stop = n + (n % 3 == 1)  # an empty suffix ends the first half of the names
    sample = np.concatenate([np.arange(1, stop, 3), np.arange(2, stop, 3)])
    order, new = _sorted(text[sample], text[sample + 1], text[sample + 2])
    if not new.all() and (enough is None or 3 * cover < enough):
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(new)
        order = suffix_order(names, enough, 3 * cover)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    first = sample[order]
    first = first[first < n]
    rest = np.arange(0, n, 3)
    rest = rest[_sorted(text[rest], rank[rest + 1])[0]]
    place = np.arange(len(rest))
    for residue in (1, 2):  # how many suffixes of the sample come before each of the others
        other = first[first % 3 == residue]
        both = np.concatenate([other, rest])
        key = _dense(text[both], rank[both + 1]) if residue == 1 else _dense(text[both], text[both + 1], rank[both + 2])
        # counts that fall stem from suffixes that agree in ``enough`` codes, whose order is free
        place = place + np.maximum.accumulate(np.searchsorted(key[: len(other)], key[len(other) :]))
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[place], free[place] = rest, False
    out[free] = first
    return out


def least_ids(contexts: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string of ``length`` in each context, one after another: the least id of a context that holds the string."""
    sizes = np.array([len(x) + 1 for x in contexts], np.int64)
    ends = np.cumsum(sizes)
    joined = np.frombuffer(b"\x00".join(contexts) + b"\x00" * 8, np.uint8)
    codes = joined[: int(ends[-1])].astype(np.int64) + 2
    codes[ends - 1] = 1  # between contexts
    owner = np.repeat(np.arange(len(contexts)), sizes)
    is_start = np.arange(len(codes)) + length < np.repeat(ends, sizes)
    order = suffix_order(codes, length)
    order = order[is_start[order]]
    words = np.zeros(len(codes), np.uint64)  # eight bytes from each place on
    for k in range(8):
        words |= joined[k : k + len(codes)].astype(np.uint64) << np.uint64(8 * k)
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for offset in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        w = words[order + offset]
        same &= w[1:] == w[:-1]
    if length < 8:
        w = words[order] & np.uint64((1 << 8 * length) - 1)
        same = w[1:] == w[:-1]
    new[1:] = ~same
    least = np.empty(len(codes), np.int64)
    if len(order):
        firsts = np.flatnonzero(new)
        least[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], firsts), np.diff(np.append(firsts, len(order))))
    return least[is_start]


class Block:
    """The anchors of a block's distinct texts."""

    def __init__(self, part: pa.Table, length: int, span: int):
        worker_state(None, lambda: None)
        self.docs, self.length = R.documents_of(part), length
        first: dict[bytes, int] = {}
        self.first = [first.setdefault(text, i) for i, (_, text) in enumerate(self.docs)]  # the first document with the same text
        self.asked = [i for text, i in first.items() if len(text) >= length]
        texts = [self.docs[i][1] for i in self.asked]
        self.groups = []  # numbers of the documents, where their texts begin in the joined text, that text, its anchors
        found = []
        for a, b in R.grouped([len(x) for x in texts], GROUP):
            sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
            joined = b"".join(texts[a:b])
            anchors = R.Anchors(R.byte_run_hash(joined, span), sizes, length, span)
            self.groups.append((np.array(self.asked[a:b]), np.cumsum(sizes) - sizes, joined, anchors))
            # how many documents have it: of one document's anchors each counts once
            owner = np.searchsorted(np.cumsum(sizes), anchors.places, "right")
            order = np.lexsort((owner, anchors.values))
            value, owner = anchors.values[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            found.append(value[new])
        self.values, self.counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def contexts(self, segments: int, replies: pa.Table) -> tuple[list[bytes], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]]:
        """Distinct contexts; per context its segment, part and least id; per group the starts, their runs and the runs' contexts."""
        again, hot = R.answers(self.values, segments, replies)
        numbers: dict[bytes, int] = {}
        values: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []
        every = np.array([i for i, _ in self.docs], np.int64)
        for docs, begin, joined, anchors in self.groups:
            kept, value = anchors.candidates(again[np.searchsorted(self.values, anchors.values)])
            if not len(kept):
                groups.append(None)
                continue
            new = np.ones(len(kept), bool)  # the last start of a text and the first of the next are never neighbours
            new[1:] = (np.diff(kept) > 1) | (value[1:] != value[:-1])
            if hot.any():
                new[1:] |= hot[np.searchsorted(self.values, value[1:])]
            first = np.flatnonzero(new)
            ends = kept[np.append(first[1:], len(kept)) - 1] + self.length
            known = len(numbers)
            own = np.fromiter((numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(kept[first].tolist(), ends.tolist(), strict=True)), np.int64, len(first))
            at = np.full(len(numbers) - known, len(first))
            fresh = np.flatnonzero(own >= known)
            np.minimum.at(at, own[fresh] - known, fresh)  # the run that brought the context
            values.append(value[first][at])
            ids.append(every[docs][np.searchsorted(begin, kept[first][at], "right") - 1])
            groups.append((kept, np.cumsum(new) - 1, own))
        contexts = list(numbers)
        v = np.concatenate(values) if values else np.zeros(0, np.uint64)
        if hot.any():
            for k in np.flatnonzero(hot[np.searchsorted(self.values, v)]).tolist():
                v[k] = xxhash.xxh3_64_intdigest(contexts[k])
        part = ((v >> np.uint64(2)) // np.uint64(segments) % np.uint64(PARTS)).astype(np.int64)
        return contexts, np.stack([R.segment_of(v, segments), part, np.concatenate(ids) if ids else np.zeros(0, np.int64)], 1), groups


def _order(facts: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((facts[:, 1], facts[:, 0]))
    return order, np.searchsorted(facts[order, 0], np.arange(segments + 1))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _send(length: int, span: int, segments: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table) -> pa.Table:
        block = Block(part, length, span)
        return R.messages(R.sketch_messages(key[0].as_py(), block.values, block.counts, segments))

    return run


def _offer(length: int, span: int, segments: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
        contexts, facts, _ = Block(part, length, span).contexts(segments, replies)
        order, bounds = _order(facts, segments)
        rows = []
        for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                own = order[a:b]
                chosen = [contexts[k] for k in own.tolist()]
                rows.append((s, key[0].as_py(), 2, b - a, np.fromiter(map(len, chosen), np.int32, b - a).tobytes(), facts[own, 2].tobytes(), facts[own, 1].astype(np.uint8).tobytes(), b"".join(chosen)))
        return R.messages(rows)

    return run


def _sort_part(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        origins, sizes, ids, parts, blobs = (part.column(c).to_pylist() for c in ("origin", "a", "b", "c", "d"))
        sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in sizes]
        ids = [np.frombuffer(x, np.int64) for x in ids]
        numbers: dict[bytes, int] = {}
        known = []  # per row: its contexts' numbers
        for blob, n in zip(blobs, sizes, strict=True):
            at = [0, *np.cumsum(n).tolist()]
            known.append(np.array([numbers.setdefault(blob[x:y], len(numbers)) for x, y in zip(at, at[1:], strict=False)], np.int64))
        contexts = list(numbers)
        del blobs, numbers
        least, part_of = np.full(len(contexts), np.iinfo(np.int64).max), np.zeros(len(contexts), np.uint8)
        for k, ident, p in zip(known, ids, parts, strict=True):
            least[k] = np.minimum(least[k], ident)  # a row has each context once
            part_of[k] = np.frombuffer(p, np.uint8)
        long = np.fromiter(map(len, contexts), np.int64, len(contexts))
        starts = long - length + 1
        begins = np.cumsum(starts) - starts
        order = np.argsort(part_of, kind="stable")
        volume = np.cumsum(np.bincount(part_of, long, PARTS))
        cuts = np.searchsorted(part_of[order], np.arange(PARTS + 1))
        # neighbouring parts are sorted together as long as they are short
        firsts = np.flatnonzero(np.diff(volume // TOGETHER, prepend=-1))
        found = np.empty(int(starts.sum()), np.int64)
        for p, q in zip(firsts.tolist(), [*firsts[1:].tolist(), PARTS], strict=True):
            own = order[cuts[p] : cuts[q]]
            if len(own):
                found[_spread(begins[own], starts[own])] = least_ids([contexts[k] for k in own.tolist()], least[own], length)
        bits = [found[_spread(begins[k], starts[k])] < np.repeat(ident, starts[k]) for k, ident in zip(known, ids, strict=True)]
        segment = part.column("key")[0].as_py()
        return R.messages([(origin, segment, 3, len(b), np.packbits(b).tobytes()) for origin, b in zip(origins, bits, strict=True)])

    return run


def _remove(length: int, span: int, segments: int, keep_text: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(part, length, span)
        contexts, facts, groups = block.contexts(segments, replies)
        order, bounds = _order(facts, segments)
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) - length + 1
        begins = np.cumsum(sizes) - sizes
        verdict = np.zeros(int(sizes.sum()), bool)
        for kind, s, n, a in zip(*(replies.column(c).to_pylist() for c in ("kind", "origin", "n", "a")), strict=True):
            if kind == 3:
                own = order[bounds[s] : bounds[s + 1]]
                verdict[_spread(begins[own], sizes[own])] = np.unpackbits(np.frombuffer(a, np.uint8), count=n)
        gone: dict[int, np.ndarray] = {}
        every = np.array([i for i, _ in block.docs], np.int64)
        for group, found in zip(block.groups, groups, strict=True):
            if found is None:
                continue
            (docs, start_of, joined, _), (kept, runs, own) = group, found
            first = np.flatnonzero(np.diff(runs, prepend=-1))
            bits = verdict[begins[own][runs] + kept - kept[first][runs]]
            ident = every[docs][np.searchsorted(start_of, kept[first], "right") - 1]
            bits |= (facts[own, 2] < ident)[runs]  # the same context starts in an earlier document of the block
            cover = np.zeros(len(joined) + 1, np.int32)
            cover[kept[bits]] += 1
            cover[kept[bits] + length] -= 1
            mask = np.cumsum(cover[:-1]) > 0
            ends = np.append(start_of[1:], len(joined))
            touched = np.add.reduceat(mask, start_of, dtype=np.int64) > 0
            for k in np.flatnonzero(touched).tolist():
                gone[int(docs[k])] = mask[start_of[k] : ends[k]]
        rows = []
        for i, (ident, text) in enumerate(block.docs):
            n = len(text)
            removed = spans = 0
            first = block.first[i]
            if n >= length and block.docs[first][0] < ident:  # the text as a whole starts in an earlier document of the block
                removed, spans, text = n, 1, b""
            elif first in gone:
                mask = gone[first]
                removed = int(mask.sum())
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                text = np.frombuffer(text, np.uint8)[~mask].tobytes()
            rows.append((None if ident == R.NULL_ID else ident, n, removed, spans, text.decode("utf-8", "ignore") if keep_text else hashlib.sha256(text).hexdigest()))
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text" if keep_text else "kept_sha256"]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        if "rest" in part.column_names:
            columns, names = [*columns, R.rests_of(part)], [*names, "rest"]
        return pa.table(columns, names=names)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, span: int = SPAN, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_text`` (or ``kept_sha256``).

    Removed is every byte covered by a string of ``length`` bytes that also starts in a document of
    smaller id. A null or empty text has no bytes; a null id counts as the smallest; rows that
    repeat an id remove nothing from each other. Where a cut splits a character, ``kept_text``
    leaves out what is no longer valid UTF-8; the digest is of the bytes. Columns named in ``keep``
    follow in a struct ``rest``, each with its row; other columns are ignored. Texts may be of any
    length; an empty table gives none.
    """
    need(docs, [id_col, text_col])
    blocks, segments = R.blocks_of(docs, id_col, text_col, keep)
    grouped = blocks.groupBy("key")  # one exchange, read by all three stages
    sketches = grouped.applyInArrow(_send(length, span, segments), R.MESSAGE)
    estimates = sketches.groupBy("key").applyInArrow(lambda part: R.merge_sketches(part, HOT), R.MESSAGE)
    offers = grouped.cogroup(estimates.groupBy("key")).applyInArrow(_offer(length, span, segments), R.MESSAGE)
    verdicts = offers.groupBy("key").applyInArrow(_sort_part(length), R.MESSAGE)
    last = "kept_text" if keep_text else "kept_sha256"
    fields = [*[T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], T.StructField(last, T.StringType()), *([blocks.schema["rest"]] if keep else [])]
    return grouped.cogroup(estimates.unionByName(verdicts).groupBy("key")).applyInArrow(_remove(length, span, segments, keep_text), T.StructType(fields))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in an earlier document removed from all documents."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_text=False)

"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact check.

A document is the multiset of its runs of five words. Over the plane of time and weight each shingle
has a Poisson process, cut into strips of weight that double: (0, 1], (1, 2], (2, 4] and so on. A
shingle that occurs c times sees the points of its strips up to weight c. Each point belongs to one
of the signature's components, which keeps its earliest point: two documents have the same point
there with probability equal to their weighted Jaccard similarity. Times beyond the last component
to be filled are never drawn, so a signature costs about as much as the document is long.

Bands of the signature give candidates, which the exact multiset overlap confirms. Copies with the
same words are joined first. In each bucket of a band every member is compared with the least one;
members found unlike it are compared with all others that are not yet in their class and whose sizes
allow a link, each pair in the first band that both share. So every pair of one bucket is linked or
known to be unlike, but for those already in one class, and a bucket of copies costs as many pairs as
it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import few, need, stage, table, text_batches, trim, worker_state
from .graph import components
from .words import word_numbers

WORDS, SIMILARITY = 5, 0.8
BROADCAST_IDS = 2_000_000  # ids (8 bytes each) that are broadcast at most; more are joined by a shuffle
BANDS, ROWS = 25, 5  # at a similarity of 0.8 a pair is missed by all bands once in 20 000
SLICE = 250  # texts that are worked on at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Text number and 64-bit hash of each run of ``words`` words (lower case), sorted; and each text's words as numbers.

    A text of fewer words has one run, of all of them; a null, empty or blank text has none.
    """
    sizes, numbers = word_numbers([(x or "").lower().encode("utf-8", "surrogatepass") for x in texts])
    ends = np.cumsum(sizes)
    own = [numbers[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs = R.run_hash(R.prefix_hash(numbers[:, 0]), words)
    whole = doc[: len(runs)] == doc[words - 1 :] if len(runs) else np.zeros(0, bool)
    owner, values = doc[: len(runs)][whole], runs[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        owner = np.concatenate([owner, short])
        values = np.concatenate([values, np.array([xxhash.xxh3_64_intdigest(own[i]) for i in short], np.uint64)])
    order = np.lexsort((values, owner))
    return owner[order], values[order], own


def occurrences(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Number from 0 of each repeat of a value in its text; both arrays sorted."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))


def signatures(owner: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    """Earliest times, ``n`` by ``size``, for texts given by sorted shingles; infinite for a text without any."""
    repeat = occurrences(owner, values)
    last = np.ones(len(values), bool)
    last[:-1] = repeat[1:] == 0
    doc, shingle, count = owner[last], values[last], repeat[last] + 1
    total = np.bincount(owner, minlength=n).astype(float)
    strips = np.where(count > 1, np.ceil(np.log2(count)), 0).astype(np.int64) + 1
    item = np.repeat(np.arange(len(doc)), strips)
    level = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed = R.mixed(shingle[item] + level.astype(np.uint64) * _ODD, 1)
    out = np.full((n, size), np.inf)
    until = np.where(total > 0, (np.log(size) + 3) / np.maximum(total, 1), 0.0)
    open_docs = total > 0
    while open_docs.any():
        live = np.flatnonzero(open_docs[doc[item]])
        time, step, flat = np.zeros(len(live)), 0, out.reshape(-1)
        while len(live):
            step += 1
            random = R.mixed(seed[live] + np.uint64((step * int(_ODD)) % 2**64))
            time = time - np.log(((random >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (width[live] * size)
            keep = time < until[doc[item[live]]]
            live, time, random = live[keep], time[keep], random[keep]
            more = R.mixed(random, 1)
            weight = low[live] + width[live] * ((more >> np.uint64(32)).astype(float) + 0.5) * 2.0**-32
            seen = weight <= count[item[live]]
            place = doc[item[live]] * size + ((more & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(flat, place[seen], time[seen])
        open_docs &= np.isinf(out).any(1)  # rarely a component is still empty: look further ahead
        until = until * 2
    return out


def bands(times: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One hash per band and text, the band's number included."""
    bits = times[:, : count * rows].copy().view(np.uint64).reshape(len(times), count, rows)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _ODD, bits.shape[:2]).copy()
    for k in range(rows):
        out = R.mixed(out * _ODD + bits[:, :, k])
    return out.view(np.int64)


def _sketch(words: int, count: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                owner, values, own = shingles(part.column(1).to_pylist(), words)
                n = part.num_rows
                keys = bands(signatures(owner, values, n, count * rows), count, rows)
                filled = np.bincount(owner, minlength=n) > 0
                prints = [xxhash.xxh3_128_digest(x) if x else None for x in own]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(filled, count, 0))]).astype(np.int32)), pa.array(keys[filled].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), lists], names=["doc_id", "print", "bands"])

    return run


def _elements(words: int):
    """Sorted hashes of (shingle, number of its repeat), so that multiset overlap becomes set overlap; and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                owner, values, _ = shingles(part.column(1).to_pylist(), words)
                values = R.mixed(values + occurrences(owner, values).astype(np.uint64) * _ODD)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                rows = [np.sort(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()), pa.array(np.diff(bounds), pa.int64())], names=["id", "elements", "size"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets as ``_elements`` gives them."""
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return common / (len(x) + len(y) - common)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            same = [overlap(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)) >= similarity for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["x", "y", "linked"])

    return run


class _Bucket:
    """Members of a bucket that meet: which pairs of different classes may be alike.

    A pair is looked at in the first band that both share. Its similarity is at most the quotient of
    the sizes, the smaller by the larger.
    """

    def __init__(self, part: pa.Table, similarity: float):
        self.ids, self.classes, self.outer, self.query, self.member, self.sizes = (part.column(c).to_numpy() for c in ("id", "class_id", "outer", "query", "member", "size"))
        self.bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        self.band, self.similarity = part.column("band")[0].as_py(), similarity

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each query with the members to compare it with; of two that are both outside the largest class, that of lower id has the other."""
        others = np.flatnonzero(self.member)
        for i in np.flatnonzero(self.query).tolist():
            n = self.sizes[others]
            far = others[(self.classes[others] != self.classes[i]) & (~self.outer[others] | (self.ids[others] > self.ids[i])) & (np.minimum(n, self.sizes[i]) >= self.similarity * np.maximum(n, self.sizes[i]) * (1 - 1e-12))]
            if len(far):
                far = far[~(self.bands[far, : self.band] == self.bands[i, : self.band]).any(1)]
            yield i, far


_MEETING = ("key", "block", "side", "id", "class_id", "outer", "query", "member", "band", "size", "bands")


def _survivors(similarity: float):
    """The rows of a bucket that have somebody to be compared with."""

    def run(part: pa.Table) -> pa.Table:
        keep = np.zeros(part.num_rows, bool)
        for i, far in _Bucket(part, similarity).likely():
            keep[far] = True
            keep[i] |= len(far) > 0
        return part.select(_MEETING).filter(pa.array(keep))

    return run


def _compare(similarity: float):
    """Links between different classes of a bucket, but for those that follow from links found before."""

    def run(part: pa.Table) -> pa.Table:
        trim()
        bucket = _Bucket(part, similarity)
        elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("elements")]
        links: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        for i, far in bucket.likely():
            own = bucket.classes[i].item()
            for j in far.tolist():
                a, b = root(own), root(bucket.classes[j].item())
                if a != b and overlap(elements[i], elements[j]) >= similarity:
                    links.append((int(bucket.ids[i]), int(bucket.ids[j])))
                    parent[a] = b
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])

    return run


def near_duplicate_classes(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, count: int = BANDS, rows: int = ROWS, chunk: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``class_id`` of every row: classes are the connected components of all links.

    A link is a weighted Jaccard similarity of at least ``similarity``; ``class_id`` is the least id
    of the class. Texts without words are alone in their class. A null id counts as the least. Rows
    that repeat an id have a row each, with the class of their text. Other columns are ignored; an
    empty table gives none. Texts may be of any length. A pair at the limit is met by some band but
    once in 20 000; every pair that is met is compared exactly.
    """
    need(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(R.NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    seen = Observation()
    sketch = stage(source.mapInArrow(_sketch(words, count, rows), "doc_id long, print binary, bands array<long>").observe(seen, F.count(F.lit(1)).alias("n")), "sketches")
    n = max(1, seen.get["n"])
    narrow = -(-n * count // 400_000)  # files for a row of a few numbers per document and band
    copies = stage(sketch.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "copies", files=-(-n // 25_000))
    members = copies.select("rep", F.posexplode("bands").alias("band", "key"))
    leaders = members.groupBy("key").agg(F.min("rep").alias("x"), F.count("rep").alias("n")).where("n > 1")
    members = stage(members.join(leaders, "key"), "members", files=narrow)
    pairs = stage(members.where("rep <> x").select("x", F.col("rep").alias("y")).distinct(), "pairs", files=narrow)
    involved = members.select(F.col("rep").alias("id")).distinct()
    if involved.count() <= BROADCAST_IDS:
        involved = F.broadcast(involved)
    elements = stage(source.join(involved, "id", "left_semi").mapInArrow(_elements(words), "id long, elements binary, size long"), "elements")

    one = elements.select(F.col("id").alias("x"), F.col("elements").alias("a"))
    two = elements.select(F.col("id").alias("y"), F.col("elements").alias("b"))
    checked = pairs.join(one, "x").join(two, "y").select("x", "y", "a", "b").mapInArrow(_verify(similarity), "x long, y long, linked boolean")
    links = stage(checked.where("linked").select("x", "y"), "links", files=few(docs.sparkSession, 4))

    found = components(links)
    placed = members.select("key", "band", F.col("rep").alias("id")).join(found, "id", "left").select("key", "band", "id", F.coalesce("class_id", "id").alias("class_id"))
    per_class = placed.groupBy("key", "class_id").agg(F.count("id").alias("n"))
    mixed = per_class.groupBy("key").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("rest"), F.count("n").alias("classes")).where("classes > 1")
    # queries are the members outside a bucket's largest class; queries and members meet chunk by chunk
    cut = placed.join(mixed, "key").withColumn("blocks", F.ceil(F.col("n") / chunk)).withColumn("sides", F.ceil(F.col("rest") / chunk))
    outer = (F.col("class_id") != F.col("main")).alias("outer")
    own, side = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("sides"))
    as_member = cut.select("key", "band", "id", "class_id", outer, F.lit(False).alias("query"), F.lit(True).alias("member"), own.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("side"))
    as_query = cut.where(outer).select("key", "band", "id", "class_id", outer, F.lit(True).alias("query"), F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), side.alias("side"))
    meeting = as_member.unionByName(as_query).groupBy("key", "block", "side", "id", "class_id", "outer").agg(F.min("band").alias("band"), F.max("query").alias("query"), F.max("member").alias("member"))
    facts = elements.select("id", "size").join(copies.select(F.col("rep").alias("id"), "bands"), "id")
    schema = "key long, block long, side long, id long, class_id long, outer boolean, query boolean, member boolean, band int, size long, bands array<long>"
    likely = stage(meeting.join(facts, "id").groupBy("key", "block", "side").applyInArrow(_survivors(similarity), schema), "likely", files=few(docs.sparkSession, 4))
    more = likely.join(elements.select("id", "elements"), "id").groupBy("key", "block", "side").applyInArrow(_compare(similarity), "x long, y long")

    # what was linked before is one node now
    ends = stage(more, "links", files=few(docs.sparkSession, 4)).join(found.select(F.col("id").alias("x"), F.col("class_id").alias("cx")), "x", "left").join(found.select(F.col("id").alias("y"), F.col("class_id").alias("cy")), "y", "left")
    joined = components(ends.select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"))).withColumnRenamed("class_id", "whole")
    named = copies.select("print", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("class_id", "rep").alias("class_id"))
    named = named.join(joined.withColumnRenamed("id", "class_id"), "class_id", "left").select("print", F.coalesce("whole", "class_id").alias("class_id"))
    worded = sketch.where(F.col("print").isNotNull()).select("doc_id", "print").join(named, "print").select("doc_id", "class_id")
    out = worded.unionByName(sketch.where(F.col("print").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))
    return out.select(F.nullif("doc_id", F.lit(R.NULL_ID)).alias("doc_id"), F.nullif("class_id", F.lit(R.NULL_ID)).alias("class_id"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents: five-word shingles, similarity 0.8 or more."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))

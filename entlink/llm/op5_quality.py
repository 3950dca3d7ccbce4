"""Quality classifier: a linear hinge-loss model over n-grams scaled by naive Bayes log-count ratios.

Features are indicators of words, of word shapes, of pairs of neighbouring shapes and of a word
that repeats its neighbour, hashed into a fixed number of places. Each is scaled by the log ratio of
its rates in the two classes, and texts are scaled to unit length. The model is fitted by dual
coordinate descent and its margins become probabilities by a logistic fit on rows it did not see.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, need, table, text_batches, worker_state
from .op4_language import sample_rows

PLACES = 1 << 18  # hashed features; place 0 is the bias
THRESHOLD = 0.3


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits become one sign each; all else stays."""
    out = []
    for c in word:
        sign = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if sign not in "Aa0" or not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def _place(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}{text}".encode("utf-8", "surrogatepass")) % (PLACES - 1) + 1


class Features:
    """Distinct feature places of many texts, with a memo of words.

    The memo holds ``memo_chars`` characters at most (a word counts 100 more for its entry) besides
    what the texts at hand need.
    """

    def __init__(self, memo_chars: int = 12_000_000):
        self.room, self.memo_chars, self.memo, self.words, self.shapes = memo_chars, memo_chars, {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.repeat = _place("r", "")

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and places, each pair once, in order; every text has the bias place 0."""
        per_doc = [x.split() if x else [] for x in texts]
        wanted = set().union(*per_doc)
        new = list(wanted - self.memo.keys())
        self.room -= sum(map(len, new)) + 100 * len(new)
        if self.room < 0:
            self.memo, self.words, self.shapes, new = {}, self.words[:0], self.shapes[:0], list(wanted)
            self.room = self.memo_chars - sum(map(len, new)) - 100 * len(new)
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.words = np.concatenate([self.words, np.array([_place("w", w) for w in new], np.int64)])
        self.shapes = np.concatenate([self.shapes, np.array([_place("s", shape(w)) for w in new], np.int64)])
        sizes = np.array([len(x) for x in per_doc], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        got = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(per_doc)), np.int64, int(sizes.sum()))
        shapes, same = self.shapes[got], doc[1:] == doc[:-1]
        pairs = ((shapes[:-1] * 0x9E3779B1 + shapes[1:] * 0x85EBCA77) >> 7) % (PLACES - 1) + 1
        repeats = same & (got[1:] == got[:-1])
        keys = np.concatenate([
            np.arange(len(texts)) * PLACES,
            doc * PLACES + self.words[got],
            doc * PLACES + shapes,
            (doc[1:] * PLACES + pairs)[same],
            doc[1:][repeats] * PLACES + self.repeat,
        ])
        keys = np.unique(keys)
        return keys // PLACES, keys % PLACES


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    ratios = np.zeros(PLACES)
    for sign in (1, -1):
        counts = np.full(PLACES, smoothing)
        for row, y in zip(rows, labels, strict=True):
            if y == sign:
                counts[row] += 1
        ratios += sign * np.log(counts / counts.sum())
    ratios[0] = 1.0  # the bias is not scaled
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + cost * sum of hinge losses, one dual variable at a time."""
    weights, alpha, rng = np.zeros(PLACES), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float(v @ v) for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] == 0:
                continue
            y, row, value = labels[i], rows[i], values[i]
            gradient = y * float(weights[row] @ value) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            if new != alpha[i]:
                weights[row] += (new - alpha[i]) * y * value
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights


class QualityModel:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        """``labels`` are 1 and -1. With one class only the score is that class's smoothed rate."""
        self.token = uuid.uuid4().hex
        positive = int((labels == 1).sum())
        self.constant = None if 0 < positive < len(labels) else (positive + 1) / (len(labels) + 2)
        if self.constant is not None:
            return
        fold = np.arange(len(rows)) % 2
        margins = np.zeros(len(rows))
        for k in (0, 1):  # each half is scored by a model of the other, for the logistic fit
            inside = [i for i in range(len(rows)) if fold[i] != k]
            if len(set(labels[inside])) < 2:
                continue
            self._fit([rows[i] for i in inside], labels[inside])
            for i in np.flatnonzero(fold == k):
                margins[i] = self.margin(rows[i])
        self.slope, self.offset = _logistic(margins, labels)
        self._fit(rows, labels)

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        ratios = log_count_ratios(rows, labels)
        values = [ratios[r] / np.linalg.norm(ratios[r]) for r in rows]
        self.squares = (ratios**2).astype(np.float32)
        self.weights = (dual_coordinate_descent(rows, values, labels) * ratios).astype(np.float32)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=float) / np.sqrt(self.squares[row].sum(dtype=float)))

    def scores(self, doc: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        margins = np.bincount(doc, self.weights[places], n) / np.sqrt(np.bincount(doc, self.squares[places], n))
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with the targets smoothed by class size."""
    positive, negative = (labels == 1).sum(), (labels == -1).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, w = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_quality_model(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learn from at most ``train_rows`` labelled rows outside the held-out fold (those whose id hashes lowest).

    Their distinct feature places are all that the driver gets. Rows with a null label or id are
    not used; a null text is an empty one. Of labels that repeat an id the least counts, of
    documents that repeat one the least text, so an id is one training row. Other columns are ignored.
    """
    need(docs, [id_col, text_col])
    need(labels, [id_col, label_col])
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = sample_rows(usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label")), train_rows, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            doc, places = features.of(batch.column(1).to_pylist())
            rows = np.split(places.astype(np.int32), np.flatnonzero(np.diff(doc)) + 1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["id", "label", "places"])

    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    one = labelled.groupBy(F.col("_id").cast("long").alias("id")).agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    rows = one.mapInArrow(run, "id long, label int, places array<int>").toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable") if rows.num_rows else []
    places = rows.column("places").to_pylist()
    signs = np.where(rows.column("label").to_numpy() > 0, 1, -1) if rows.num_rows else np.zeros(0, int)
    return QualityModel([np.array(places[i], np.int64) for i in order], signs[order] if rows.num_rows else signs)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` to every row; whole texts, of any length.

    Null and empty texts have no features but the bias and get its score. Repeated rows and ids are
    scored one by one; a score of just ``threshold`` is predicted 1. Other columns pass through unseen; columns named ``score`` or ``predicted`` raise an error.
    """
    need(docs, [text_col])
    if clash := {"score", "predicted"} & set(docs.columns):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    text_batches(docs.sparkSession)
    at, token, packed = docs.columns.index(text_col), model.token, zlib.compress(pickle.dumps(model), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = worker_state(token, lambda: (Features(), pickle.loads(zlib.decompress(packed))))  # once a worker
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                scores = model.scores(*features.of(part.column(at).to_pylist()), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; labels are learnt outside the held-out fold only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality_model(docs, labels)
    return score_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")

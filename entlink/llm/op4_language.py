"""Language identification: words first, shorter and shorter character n-grams for unseen words.

A word met in training scores by its log frequency in each language. Another word scores, at each of
its characters, by the longest n-gram that begins there and was met in training (from five characters
down to one; word ends count as characters), averaged over the characters. A text's language is the
one with the largest sum over its words.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, need, table, text_batches, trim, worker_state

_RUNS = re.compile(r"[^\W\d_]+")  # letters, and numerals such as a half that are no decimal digits
UNKNOWN = "und"
_LONGEST = 5
_PRIME = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _grams(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word number of each character, characters per word, and for each n (from 1) hashes and whether they stay in the word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at, hashes, power, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 1, []
    for n in range(1, longest + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :] if n <= len(codes) else 0
        hashes = hashes + shifted * np.uint64(power)
        power = power * _PRIME % 2**64
        mixed = (hashes + np.uint64(n)) * _MIX
        out.append((mixed ^ (mixed >> np.uint64(29)), at + n <= ends))
    return owner, sizes, out


def words_of(text: str) -> list[str]:
    """Maximal runs of letters (Unicode category L), lower case."""
    runs = _RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


class LanguageModel:
    """Word and n-gram log frequencies. ``counts``: for each language the counts of its words.

    Words and n-grams met fewer than ``least`` times in all languages together are left out; by
    default none is.
    """

    def __init__(self, counts: dict[str, Counter], longest: int = _LONGEST, smoothing: float = 0.5, least: int = 1):
        self.languages, self.longest, self.token = sorted(counts), longest, uuid.uuid4().hex
        width = len(self.languages)
        totals = np.array([sum(counts[x].values()) for x in self.languages], float)
        self.prior = np.log((totals + 1) / (totals + 1).sum()) if width else totals
        both = Counter()
        for x in self.languages:
            both.update(counts[x])
        self.words = sorted(w for w, n in both.items() if n >= least)
        table = np.array([[counts[x][w] for x in self.languages] for w in self.words], float).reshape(len(self.words), width)
        self.word_scores = np.log((table + smoothing) / (totals + smoothing * (len(both) + 1))).astype(np.float32)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(longest)]
        for x in self.languages:
            words = list(counts[x])
            owner, _, levels = _grams(words, longest)
            times = np.array([counts[x][w] for w in words], float)[owner] if words else np.zeros(0)
            for n, (hashes, inside) in enumerate(levels):
                keys, inverse = np.unique(hashes[inside], return_inverse=True)
                found[n].append((keys, np.bincount(inverse, times[inside], len(keys))))
        for level in found:
            keys = np.unique(np.concatenate([k for k, _ in level])) if level else np.zeros(0, np.uint64)
            table = np.zeros((len(keys), width))
            for j, (k, n) in enumerate(level):
                table[np.searchsorted(keys, k), j] = n
            often = table.sum(1) >= least
            scores = np.log((table + smoothing) / (table.sum(0) + smoothing * (len(keys) + 1)))
            self.grams.append((keys[often], scores[often].astype(np.float32)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores by backoff; zeros if no character of a word was met in training."""
        owner, sizes, levels = _grams(words, self.longest)
        got = np.zeros((len(owner), len(self.languages)), np.float32)
        open_at = np.arange(len(owner))
        for (hashes, inside), (keys, scores) in zip(reversed(levels), reversed(self.grams), strict=True):
            if not len(open_at) or not len(keys):
                continue
            wanted = hashes[open_at]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = (keys[place] == wanted) & inside[open_at]
            got[open_at[hit]] = scores[place[hit]]
            open_at = open_at[~hit]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(got, starts) / sizes[:, None].astype(np.float32) if len(words) else got


class _Scorer:
    """A model with a memo of words, kept by a Python worker.

    The memo holds ``memo_chars`` characters at most (a word counts 100 more for its entry), and
    longer words are scored each time they are met.
    """

    def __init__(self, model: LanguageModel, memo_chars: int = 8_000_000):
        self.model, self.room, self.memo_chars = model, memo_chars, memo_chars
        self.known = dict(zip(model.words, range(len(model.words)), strict=True))
        model.words = []  # the dictionary has them
        self.memo, self.scores = {}, np.zeros((0, len(model.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        if not model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        per_doc = [words_of(x) if x else [] for x in texts]
        wanted = set().union(*per_doc)
        new = list(wanted - self.memo.keys())
        self.room -= sum(map(len, new)) + 100 * len(new)
        if self.room < 0:  # what these texts need is kept until the next ones come
            self.memo, self.scores, new = {}, self.scores[:0], list(wanted)
            self.room = self.memo_chars - sum(map(len, new)) - 100 * len(new)
        if new:
            seen = [w for w in new if w in self.known]
            other = [w for w in new if w not in self.known]
            self.memo.update(zip(seen + other, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, model.word_scores[np.array([self.known[w] for w in seen], np.int64)], model.unseen(other)])
        languages, out = [], []
        get = self.memo.__getitem__
        for words in per_doc:
            if not words:
                languages.append(UNKNOWN), out.append(0.0)
                continue
            sums = self.scores[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
            sums += model.prior
            chances = np.exp(sums - sums.max())
            best = int(np.argmax(chances))  # ties: the first in alphabetical order
            languages.append(model.languages[best]), out.append(float(1 / chances.sum()))
        return languages, out


def sample_rows(rows: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows: those whose id hashes lowest, ties by the columns in their order.

    A bound on the hash, from the number of rows, leaves little more than ``limit`` rows before any of
    them moves. Should chance leave fewer, the sample is a little smaller.
    """
    share = (1.2 * limit + 50) / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.xxhash64(id_col) <= int(share * 2**64) - 2**63)
    return rows.orderBy(F.xxhash64(id_col), *rows.columns).limit(limit)


def fit_language_model(docs: DataFrame, train_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from at most ``train_docs`` documents outside the held-out fold with text and language.

    The documents are those whose id hashes lowest, ties by id and text. Their words, counted on the executors, are all
    that the driver gets. Without any such document the model knows no language.
    """
    need(docs, [id_col, text_col, lang_col])
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample_rows(usable, train_docs, id_col).select(text_col, lang_col).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in words.columns), strict=True):
        counts.setdefault(lang, Counter())[word] = n
    del words
    model = LanguageModel(counts)
    del counts
    trim()
    return model


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the language's share of probability) to every row.

    Null, empty and letterless texts (numerals such as a half are no letters) get ``und`` and 0. Of
    equally likely languages the first in alphabetical order is taken. Whole texts count, of any
    length; repeated rows and ids are scored one by one; other columns pass through unseen; columns named ``lang_pred`` or ``score`` raise an error.
    """
    need(docs, [text_col])
    if clash := {"lang_pred", "score"} & set(docs.columns):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    text_batches(docs.sparkSession)
    at, token, packed = docs.columns.index(text_col), model.token, zlib.compress(pickle.dumps(model), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(token, lambda: _Scorer(pickle.loads(zlib.decompress(packed))))  # unpacked once a worker
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 250):
                part = batch.slice(i, 250)
                langs, scores = scorer.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; learnt outside the held-out fold only."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs)
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")

"""Each query's columns from a folder, and the models' results, against plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from entlink.llm import op6_matroska as M
from entlink.llm.op2_substring import remove_repeated_windows
from entlink.llm.op4_language import LanguageModel, _Scorer, words_of
from entlink.llm.op5_quality import PLACES, Features, QualityModel, _place, dual_coordinate_descent, log_count_ratios, shape
from entlink.llm.op8_templates import contaminated
from entlink.llm.op9_bagminhash import near_duplicate_classes
from entlink.llm.queries import QUERIES
from entlink.llm.words import pieces, word_numbers

from .test_dedup import plain_bytes, plain_classes, plain_windows
from .test_models import plain_templates


def rows_of(df, names, types):
    assert df.columns[: len(names)] == names and [t for _, t in df.dtypes[: len(names)]] == types
    return {r[0]: tuple(r[1 : len(names)]) for r in df.collect()}


def test_substring_and_suffix_queries(spark, folder):
    path, rows, _ = folder
    assert rows_of(QUERIES["op2_substring"](spark, path), ["doc_id", "n_words", "n_removed", "kept_sha256"], ["bigint", "bigint", "bigint", "string"]) == plain_windows(rows, 20)
    assert rows_of(QUERIES["op10_suffix"](spark, path), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*["bigint"] * 4, "string"]) == plain_bytes(rows, 50)


def test_near_duplicate_and_template_queries(spark, folder):
    path, rows, items = folder
    assert {i: c for i, (c,) in rows_of(QUERIES["op9_bagminhash"](spark, path), ["doc_id", "class_id"], ["bigint", "bigint"]).items()} == plain_classes(rows)
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_templates"](spark, path).collect()} == plain_templates(rows, items)


def test_media_query(spark, folder):
    path, rows, _ = folder
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = rows_of(QUERIES["op6_matroska"](spark, path), names, ["bigint", "bigint", "bigint", "string", "bigint", "bigint", "string", "string"])
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = M.mux([padded[k : k + 192] for k in range(0, len(padded), 192)])
        assert got[i][:6] == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert f"mean={sum(padded) / len(padded):.6f}" in got[i][6]


def test_sharding_query(spark, folder):
    path, rows, _ = folder
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = rows_of(QUERIES["op7_sharding"](spark, path), names, ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"])
    assert {i: r[:3] for i, r in got.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for i, t in rows}
    sizes = Counter(r[3] for r in got.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1 and all(r[5] is None for r in got.values())
    assert all(sorted(r[4] for r in got.values() if r[3] == s) == list(range(n)) for s, n in sizes.items())


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_model_queries(spark, folder):
    path, rows, _ = folder
    got = rows_of(QUERIES["op4_language"](spark, path), ["doc_id", "held_out", "lang_pred", "score"], ["bigint", "boolean", "string", "double"])
    assert {i: r[0] for i, r in got.items()} == {i: held(i) for i, _ in rows}
    assert all(0 <= r[2] <= 1 and (r[1] == "und") == (not any(c.isalpha() for c in t or "")) for (i, t) in rows for r in [got[i]])
    got = rows_of(QUERIES["op5_quality"](spark, path), ["doc_id", "held_out", "score", "predicted"], ["bigint", "boolean", "double", "int"])
    assert {i: r[0] for i, r in got.items()} == {i: held(i) for i, _ in rows}
    assert all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.3) for r in got.values())


def test_words_are_compared_and_not_their_sums(spark):
    """Words of equal polynomial sums modulo 2**64 are different words."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    sizes, numbers = word_numbers([one.encode(), two.encode() + b" " + one.encode()])
    assert sizes.tolist() == [1, 2] and (numbers[0] == numbers[2]).all() and (numbers[0] != numbers[1]).all()
    rows = [(1, " ".join([one, "x", "y"] * 8)), (2, " ".join([two, "x", "y"] * 8)), (3, " ".join([one, "x", "y"] * 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, keep_text=False).collect()} == plain_windows(rows, 20)
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_texts_are_split_like_short_ones():
    text = b" \t".join([b"ab", b"c" * 700_000, b"d", b"e" * 2_000_000, b"f"] * 3) + b"\n"
    assert [w for some in pieces(text) for w in some.split()] == text.split()
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    words += [w + b"\0" for w in words[:2000]]
    sizes, numbers = word_numbers([b" ".join(words[:9]), b"", b"\n\t", b" " + b" \n".join(words[9:])])
    assert sizes.tolist() == [9, 0, 0, len(words) - 9]
    known = {}
    for w, (a, b) in zip(words, numbers.tolist(), strict=True):
        assert known.setdefault(w, (a, b)) == (a, b)
    assert len({a for a, _ in known.values()}) == len({b for _, b in known.values()}) == len(known)
    assert (word_numbers([text])[1] == word_numbers([b"\n".join(text.split())])[1]).all()


def test_letters_are_of_category_l():
    assert words_of("A½b ² ① Ⅷ x3y _é 漢字") == ["a", "b", "x", "y", "é", "漢字"]
    scorer = _Scorer(LanguageModel({"en": Counter({"a": 3}), "fr": Counter({"b": 2})}))
    assert scorer.predict(["½ ²", "①", "Ⅷ 3", "a½"])[0] == ["und", "und", "und", "en"]


def plain_language(counts, texts, longest=5, smoothing=0.5):
    """The model's formulas, word by word and character by character."""
    langs = sorted(counts)
    totals = {x: sum(counts[x].values()) for x in langs}
    known = set().union(*counts.values())
    grams = [{x: Counter() for x in langs} for _ in range(longest)]
    for x in langs:
        for w, n in counts[x].items():
            marked = f"\x02{w}\x03"
            for size in range(1, longest + 1):
                for a in range(len(marked) - size + 1):
                    grams[size - 1][x][marked[a : a + size]] += n

    def rate(table, x, key):
        keys = len(set().union(*table.values()))
        return math.log((table[x][key] + smoothing) / (sum(table[x].values()) + smoothing * (keys + 1)))

    out = []
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not words:
            out.append(("und", 0.0))
            continue
        sums = {x: math.log((totals[x] + 1) / sum(n + 1 for n in totals.values())) for x in langs}
        for w in words:
            marked = f"\x02{w}\x03"
            for x in langs:
                if w in known:
                    sums[x] += rate(counts, x, w)
                    continue
                for a in range(len(marked)):
                    for size in range(min(longest, len(marked) - a), 0, -1):
                        if any(marked[a : a + size] in grams[size - 1][y] for y in langs):
                            sums[x] += rate(grams[size - 1], x, marked[a : a + size]) / len(marked)
                            break
        best = max(langs, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())))
    return out


def test_language_scores_against_plain_loops():
    rng = random.Random(3)
    parts = {"aa": "ka lo mi te", "bb": "ka ru sen tol", "cc": "vix lo zem ru"}

    def word(lang):
        return "".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3)))

    counts = {x: Counter(word(x) for _ in range(25)) for x in parts}
    texts = [" ".join(word(rng.choice(list(parts))) for _ in range(rng.randint(1, 6))) + rng.choice(["", " qqq", " Kalo!", " 12 ½"]) for _ in range(60)] + ["", None, "½", "q"]
    langs, scores = _Scorer(LanguageModel(counts), memo_chars=300).predict(texts)
    want = plain_language(counts, texts)
    assert all(abs(s - w[1]) < 1e-3 and (x == w[0] or abs(w[1] - 0.5) < 1e-3) for x, s, w in zip(langs, scores, want, strict=True))


def plain_features(text):
    words = (text or "").split()
    shapes = [_place("s", shape(w)) for w in words]
    pairs = {((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) % (PLACES - 1) + 1 for a, b in zip(shapes, shapes[1:], strict=False)}
    repeats = {_place("r", "")} if any(a == b for a, b in zip(words, words[1:], strict=False)) else set()
    return {0, *(_place("w", w) for w in words), *shapes, *pairs, *repeats}


def test_quality_model_against_plain_loops():
    rng = random.Random(6)
    good, bad = ["Fine", "words", "here", "in", "order."], ["!!!", "BUY", "now", "99", "now"]
    texts = [" ".join(rng.choice(good if y else bad) if rng.random() < 0.8 else rng.choice(good + bad) for _ in range(rng.randint(1, 12))) for y in [0, 1] * 40] + [None, "", "x" * 500, "a a"]
    doc, places = Features(memo_chars=400).of(texts)
    rows = [places[doc == i] for i in range(len(texts))]
    assert [set(r.tolist()) for r in rows] == [plain_features(t) for t in texts]
    rows, labels = rows[:80], np.array([1 if y else -1 for y in [0, 1] * 40])
    ratios = log_count_ratios(rows, labels)
    for k in {int(p) for r in rows for p in r} - {0}:
        rates = []
        for sign in (1, -1):
            own = [r for r, y in zip(rows, labels, strict=True) if y == sign]
            rates.append((1 + sum(k in r for r in own)) / (PLACES + sum(len(r) for r in own)))
        assert abs(ratios[k] - math.log(rates[0] / rates[1])) < 1e-9
    values = [ratios[r] / np.linalg.norm(ratios[r]) for r in rows]
    weights = dual_coordinate_descent(rows, values, labels, epochs=3000)

    def objective(w):
        return 0.5 * w @ w + sum(max(0.0, 1 - y * float(w[r] @ v)) for r, v, y in zip(rows, values, labels, strict=True))

    used, noise, best = np.unique(np.concatenate(rows)), np.random.default_rng(1), objective(weights)
    for scale in (1e-3, 1e-2, 1e-1):
        for _ in range(60):  # nothing near the weights has a lower objective
            other = weights.copy()
            other[used] += scale * noise.normal(size=len(used))
            assert objective(other) >= best - 2e-4
    model = QualityModel(rows, labels)
    scores = model.scores(np.repeat(np.arange(80), [len(r) for r in rows]), np.concatenate(rows), 80)
    for r, s in zip(rows, scores, strict=True):
        margin = sum(float(model.weights[k]) for k in r) / math.sqrt(sum(float(model.squares[k]) for k in r))
        assert abs(s - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-5
    assert ((scores >= 0.5) == (labels > 0)).mean() > 0.9


@pytest.mark.parametrize("chunk", [7, 1000])
def test_recall_by_similarity(spark, chunk):
    """Copies with more and more words changed: each pair of similarity 0.8 or more is in one class, the others are not."""
    rng = random.Random(chunk)
    rows = []
    for group in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
        rows.append((100 * group, " ".join(words)))
        for k in range(1, 12):
            other = list(words)
            for at in rng.sample(range(5, 290), k):
                other[at] = f"n{rng.randint(0, 10**6)}"
            rows.append((100 * group + k, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df, chunk=chunk).collect()} == plain_groups(rows)


def plain_groups(rows):
    """``plain_classes`` within each hundred of ids; texts of different hundreds have nothing in common."""
    out = {}
    for group in {i // 100 for i, _ in rows}:
        out |= plain_classes([r for r in rows if r[0] // 100 == group])
    return out


def test_templates_with_clashing_columns_and_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten of 5 kg"
    rows = [(1, item, 5, "x"), (1, item, 5, "x"), (1, "nothing", 5, "x"), (None, "a " + item.replace("5", "7"), 5, "x"), (None, "other", 5, "x"), (2, None, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int, hash string")
    bench = spark.createDataFrame([(1, item, 2), (1, item, 2), (2, "", 3), (3, "nothing", 3), (3, "other", 3)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(df, bench).collect()) == [(0, 1), (0, 3), (1, 1), (1, 3)]

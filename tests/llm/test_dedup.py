"""Exact and near deduplicators against plain loops."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entlink.llm.graph import components
from entlink.llm.op2_substring import remove_repeated_windows
from entlink.llm.op9_bagminhash import bands, near_duplicate_classes, shingles, signatures
from entlink.llm.op10_suffix import least_ids, remove_repeated_bytes, suffix_order


def plain_windows(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 5])
def test_word_windows(docs, corpus, empty, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(docs, window, keep_text=False).collect()}
    assert got == plain_windows(corpus, window)
    assert remove_repeated_windows(empty).count() == 0


def plain_bytes(rows, length):
    texts, first, out = {i: (t or "").encode() for i, t in rows}, {}, {}
    for i, t in sorted(texts.items()):
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], i)
    for i, t in texts.items():
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_bytes(docs, corpus, empty, monkeypatch, hot):
    monkeypatch.setattr("entlink.llm.op10_suffix.HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(docs, keep_text=False).collect()}
    assert got == plain_bytes(corpus, 50)
    assert remove_repeated_bytes(empty).count() == 0


def test_null_and_repeated_ids(spark):
    t = "some text that is long enough to be repeated as a whole, and then a little more"
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "short"), (3, "short")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_bytes(df).collect()) == [(0, 0), (1, len(t)), (1, len(t)), (2, 0), (3, 0)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_windows(df, 5).collect()) == [(0, 0), (1, len(t.split())), (1, len(t.split())), (2, 0), (3, 0)]
    twice = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeated_bytes(twice).collect()] == [0, 0]
    got = near_duplicate_classes(df).collect()
    assert sorted((r.doc_id is None, r.class_id is None) for r in got) == [(False, False)] * 2 + [(False, True)] * 2 + [(True, True)]
    assert {r.class_id for r in got if r.doc_id in (2, 3)} == {2}


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(300):
        codes = np.array([rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 40))], np.int64)
        assert suffix_order(codes).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    for _ in range(200):
        n = rng.choice([3, 5, 8, 10])
        contexts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(n, 30))) for _ in range(rng.randint(1, 8))})
        ids = np.array([rng.randint(0, 9) for _ in contexts])
        least = {}
        for c, i in zip(contexts, ids.tolist(), strict=True):
            for a in range(len(c) - n + 1):
                least[c[a : a + n]] = min(least.get(c[a : a + n], 99), i)
        assert least_ids(contexts, ids, n).tolist() == [least[c[a : a + n]] for c in contexts for a in range(len(c) - n + 1)]


def multiset(text):
    words = (text or "").lower().encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def plain_classes(rows):
    sets, parent = {i: multiset(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates(docs, corpus, empty):
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(docs).collect()} == plain_classes(corpus)
    assert near_duplicate_classes(empty).count() == 0


def test_chain_of_near_copies(spark):
    """Neighbours are alike, the ends are not: one class, whichever document leads a bucket."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words[(i * 2) % 120] = f"new{i}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df, chunk=7).collect()} == plain_classes(rows)


def test_signatures_are_unbiased():
    rng = random.Random(4)
    for _ in range(6):
        a = [rng.choice("abcdefgh") for _ in range(60)]
        b = a[: rng.randint(5, 60)] + [rng.choice("abcdefghxyz") for _ in range(10)]
        owner, values, _ = shingles([" ".join(a), " ".join(b)], 1)
        times = signatures(owner, values, 2, 4000)
        assert np.isfinite(times).all()
        common = sum((Counter(a) & Counter(b)).values())
        true = common / (len(a) + len(b) - common)
        assert abs((times[0] == times[1]).mean() - true) < 4.5 * np.sqrt(true * (1 - true) / 4000) + 1e-9
    assert bands(times, 10, 5).shape == (2, 10)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for x, y in edges:
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    loops = {x for x, y in edges if x == y} - {v for x, y in edges if x != y for v in (x, y)}
    got = {r.id: r.class_id for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: root(i) for i in parent if i not in loops}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a" * 60), (2, "b " + "a" * 60 + "é")], "doc_id long, text string")
    assert [r.kept_text for r in remove_repeated_bytes(df).orderBy("doc_id").collect()] == ["a" * 60, "b é"]
    assert remove_repeated_windows(df.select("doc_id", F.lit("a b  a b\nc").alias("text")).where("doc_id = 1"), 2).first().kept_text == "a b c"

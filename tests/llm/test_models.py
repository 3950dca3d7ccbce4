"""Language and quality models, templates, sharding, media and the pipeline."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from entlink.llm import op6_matroska as M
from entlink.llm import op8_templates as T
from entlink.llm.op4_language import LanguageModel, fit_language_model, identify_language
from entlink.llm.op5_quality import QualityModel, dual_coordinate_descent, fit_quality_model, score_quality, shape
from entlink.llm.op7_sharding import _log_binomial, dealer, hypergeometric, matrix_row, shard_uniformly

DATA = Path("/root/testdata/sf0.01")
have_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@have_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = identify_language(docs, fit_language_model(docs)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    row = scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.a > 0.98 and 0 <= row.low and row.high <= 1


def test_language_edges(spark, docs, empty):
    train = spark.createDataFrame([(i, "le chat noir" if i % 2 else "the black cat", "fr" if i % 2 else "en", 1) for i in range(40)], "doc_id long, text string, lang string, n int")
    model = fit_language_model(train)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! _"), (4, "the cat"), (5, "blacks"), (6, "漢字")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == got[5][0] == "en" and got[6][0] in ("en", "fr")
    assert identify_language(empty, model).count() == 0
    none = fit_language_model(train.where("doc_id < 0"))
    assert {r.lang_pred for r in identify_language(odd, none).collect()} == {"und"}
    with pytest.raises(ValueError, match="clash"):
        identify_language(docs.withColumn("score", F.lit(1)), model)


def test_backoff_uses_the_longest_known_run():
    model = LanguageModel({"a": Counter({"abcde": 5, "xyz": 5}), "b": Counter({"vwxyz": 5, "abc": 5})})
    seen = model.unseen(["abcd", "wxyz"])
    assert seen[0].argmax() == 0 and seen[1].argmax() == 1


@have_data
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = score_quality(docs, fit_quality_model(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert scored.where("predicted = quality").count() / scored.count() > 0.95


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fit_quality_model(docs, labels)
    scores = [r.score for r in score_quality(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert score_quality(empty, model).count() == 0
    one = fit_quality_model(docs, labels.where("quality = 1"))
    assert len({r.score for r in score_quality(docs, one).collect()}) == 1
    assert fit_quality_model(docs, labels.where("quality > 1")).constant == 0.5
    assert [shape(w) for w in ("EDTH!!", "Thre***", "a1b", "")] == ["A!!", "Aa***", "a0a", ""]


def test_shape_reads_whole_words():
    assert shape("a" * 64 + "1" * 1000 + "B!") == "a0A!"


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])]
    labels = np.array([1, 1, -1, -1])
    w = dual_coordinate_descent(rows, [np.ones(2)] * 4, labels, epochs=200)
    assert all(y * w[r].sum() > 0.9 for r, y in zip(rows, labels, strict=True)) and abs(w[2]) < 0.05
    assert QualityModel(rows * 3, np.tile(labels, 3)).margin(rows[0]) > 0


def plain_templates(docs, items):
    """Windows of items against windows of documents, one by one; texts here have no placeholders."""
    import re

    def words(t):
        return re.sub(r"[^\w]+|_", " ", t.lower()).split()

    out = set()
    for d, t in docs:
        w = words(t or "")
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for k, x in items:
            v = words(x or "")
            parts = [tuple(v[i : i + 5]) for i in range(len(v) - 4)] if len(v) >= 5 else [tuple(v)] if v else []
            if parts and sum(p in own for p in parts) >= 0.8 * len(parts):
                out.add((d, k))
    return out


def test_templates(spark, docs, corpus, empty):
    low = [(i, t.lower() if t else t) for i, t in corpus if i != 101]
    items = [(1, dict(low)[10]), (2, " ".join((dict(low)[100] or "").split()[500:530])), (3, None), (4, ""), (5, "x"), (6, dict(low)[3]), (7, dict(low)[3])]
    df = spark.createDataFrame(low, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(r.doc_id, r.item_id) for r in T.contaminated(df, bench).collect()} == plain_templates(low, items)
    assert T.contaminated(empty, bench).count() == 0 and T.contaminated(df, bench.limit(0)).count() == 0


def test_slots(spark):
    item = "Yesterday Tom Brown had 3 apples of 5 kg and then, as Tom Brown told us, 3 apples were gone by the evening train"
    docs = [
        (1, "So what. " + item.replace("Tom Brown", "Ann").replace("3", "17").replace("5 kg", "6.5 lbs") + " and more"),
        (2, item.replace("as Tom Brown", "as Bob Young").replace(" 3 apples were", " 8 apples were").replace("had 3", "had 4")),
        (3, "nothing of this kind at all in this one"),
        (4, item),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {(r.doc_id, r.n_slots) for r in T.contaminated(df, bench).collect()}
    assert got == {(1, 6), (4, 6)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(9, item)])
    assert {(r[0], r[4]) for r in con.execute(T.ORACLE_SQL).fetchall()} == got


def test_names_at_the_start_of_sentences_and_lines(spark):
    janet = "Janet buys 16 eggs at the market. Janet eats 3 for breakfast every morning and bakes 4 for friends. \"Janet sells the rest\", they said. How much does Janet earn from Peter?"
    tom = "Tom has 3 apples. Tom buys 5 more of them. Tom gives 2 to a friend. How many are left?"
    other = janet.replace("Janet", "Mary Ann").replace("Peter", "Paul").replace("16", "20").replace("3", "7")
    docs = [
        (1, other),
        (2, "Question:\n" + other.replace(" ", "\n  ", 12)),
        (3, tom.replace("Tom", "Ann").replace("3", "8").replace("5", "6")),
        (4, tom.replace(" ", "\n").replace("Tom", "Bob")),
        (5, tom.replace("Tom", "Ann", 1).replace("Tom", "Bob", 1).replace("Tom", "Carl", 1)),
        (6, "JOHN SMITH. ANN LEE. BOB. CARL. DAVE. EVE"),
        (7, "Nothing of this kind. Ann has no apples. Bob buys 5 pens."),
    ]
    items = [(1, janet), (2, tom), (3, "ALPHA. BETA. GAMMA. DELTA. EPSILON. ZETA"), (4, "HELLO")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in T.contaminated(df, bench).collect()} == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_template_plan_has_no_python(docs, spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = T.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_communication_matrix():
    counts, columns = np.array([5, 0, 17, 3, 40]), np.array([10, 20, 30, 5])
    rows = np.array([matrix_row(p, counts, columns, 1) for p in range(5)])
    assert (rows.sum(0) == columns).all() and (rows.sum(1) == counts).all()
    means = np.mean([matrix_row(2, counts, columns, s) for s in range(3000)], axis=0)
    assert np.abs(means - 17 * columns / 65).max() < 0.15
    rng = np.random.default_rng(1)
    draws = [hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(draws) - 750) < 5 and abs(np.std(draws) - np.sqrt(1000 * 0.75 * 0.25)) < 2.5


def test_large_hypergeometric_law_is_exact():
    for n, k, p in ((40, 13, 0.3), (10_000, 3_000, 0.31), (10**6, 10, 1e-5), (5, 0, 0.2), (7, 7, 0.9)):
        exact = math.log(math.comb(n, k)) + k * math.log(p) + (n - k) * math.log1p(-p)
        assert abs(_log_binomial(k, n, p, 1 - p) - exact) < 1e-9 * max(1, abs(exact))
    good, bad, draws = 3 * 10**13, 10**13, 4000  # the mode and its neighbours, against integers
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    for k in (2990, 3000, 3010):
        mine = _log_binomial(k, good, p, q) + _log_binomial(draws - k, bad, p, q) - _log_binomial(draws, good + bad, p, q)
        exact = Fraction(math.perm(good, k) * math.perm(bad, draws - k) * math.comb(draws, k), math.perm(good + bad, draws))
        assert abs(math.exp(mine) / float(exact) - 1) < 1e-6


def test_sharding_law(spark):
    """Over many seeds each row is in each shard and at each place about equally often."""
    df = spark.createDataFrame([(i,) for i in range(12)], "doc_id long").repartition(4).cache()
    df.count()
    shards, slots, n = Counter(), Counter(), 60
    for seed in range(n):
        for r in shard_uniformly(df, 3, seed=seed, stable_input=True).collect():
            shards[r.doc_id, r.shard] += 1
            slots[r.doc_id, r.slot] += 1
    for seen, cells, degrees in ((shards, 36, 22), (slots, 48, 33)):  # chi-squares of two-way tables with given margins
        even = n * 12 / cells
        assert sum((seen[k] - even) ** 2 / even for k in ((i, j) for i in range(12) for j in range(cells // 12))) < degrees + 5 * math.sqrt(2 * degrees)


def test_sharding_notices_a_changed_input(spark):
    """Rows that are missing are noticed like rows that are new."""
    rows, sizes = spark.range(40).coalesce(1), np.array([20, 20])
    assert sum(r.n for r in rows.mapInArrow(dealer(np.array([40]), sizes, 3, 1, ["_cell", "n"], False), "_cell int, n long").collect()) == 40
    for n in (39, 41):
        with pytest.raises(Exception, match="input changed"):
            rows.mapInArrow(dealer(np.array([n]), np.array([n - 20, 20]), 3, 1, ["_cell", "n"], False), "_cell int, n long").collect()


@pytest.mark.parametrize(("stable", "per_cell"), [(True, 1 << 24), (False, 500)])
def test_sharding(docs, corpus, empty, stable, per_cell):
    rows = shard_uniformly(docs, 8, cell_bytes=per_cell, stable_input=stable).collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i, t or "") for i, t in corpus)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert rows[0].key == "key" and shard_uniformly(empty, 3).count() == 0
    with pytest.raises(ValueError, match="clash"):
        shard_uniformly(docs.withColumn("slot", F.lit(1)), 2)


@pytest.mark.parametrize("mixed", [M.XIPH_LACING, M.EBML_LACING])
def test_matroska_round_trip(mixed):
    rng = random.Random(mixed)
    for _ in range(40):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 254, 255, 256, 511, 4000, 70_000])) for _ in range(rng.randint(0, 30))]
        data = M.mux(frames, per_block=rng.randint(1, 9), per_cluster=3, mixed=mixed)
        media = M.parse(data)
        assert [data[p.offset : p.offset + p.length] for p in media.packets] == frames and media.doc_type == "matroska"
        assert [p.timestamp for p in media.packets] == [i * M.FRAME_MS * 1_000_000 for i in range(len(frames))]
        for when, track, at in media.cues:
            assert track == 1 and data[at : at + 4] == b"\x1f\x43\xb6\x75" and any(p.timestamp == when for p in media.packets)
    with pytest.raises(ValueError):
        M.parse(data[:-3] if frames else b"\x00")


def test_matroska_damage_is_a_value_error():
    rng = random.Random(3)
    whole = [M.mux([rng.randbytes(n) for n in (3, 300, 70, 70, 5)], per_block=3, mixed=k) for k in (M.XIPH_LACING, M.EBML_LACING)]
    bad = [M.element(M.SEGMENT, M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.uint(M.TRACK_UID, 1)))), M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.SIMPLE_BLOCK, b"\x81\x00"))), M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.SIMPLE_BLOCK, b"\x81\x00\x00\x02\x05\xff")))]
    for data in bad:
        with pytest.raises(ValueError):
            M.parse(data)
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            M.parse(bytes(data[: rng.randint(0, len(data))] if rng.random() < 0.5 else data))
        except ValueError:
            pass


def test_matroska_unknown_sizes_and_groups():
    block = b"\x81\x00\x05\x00" + b"abc"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.uint(M.BLOCK_DURATION, 9))
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + M.uint(M.CLUSTER_TIMESTAMP, 100) + group
    segment = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + M.element(M.INFO, M.uint(M.TIMESTAMP_SCALE, 1_000_000)) + cluster + cluster
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + segment
    media = M.parse(data)
    assert [(data[p.offset : p.offset + p.length], p.timestamp, p.cluster, p.keyframe) for p in media.packets] == [(b"abc", 105_000_000, 0, True), (b"abc", 105_000_000, 1, True)]


def test_media_columns(docs, corpus, empty):
    files = {r.doc_id: bytes(r.media) for r in M.media_columns(docs).collect()}
    for i, t in corpus:
        data, _ = M.payload(t)
        n, _, tail, size, _, feature = M.digest(files[i])
        assert (n, tail, size) == (len(data), zlib.crc32(data[-16:]), len(files[i])) and f"packets={len(data) // 192};" in feature
    packets = M.packet_table(M.media_columns(docs))
    assert packets.count() == sum(len(M.payload(t)[0]) // 192 for _, t in corpus) and packets.where("cued").count() >= len(corpus)
    assert M.packet_table(M.media_columns(empty)).count() == 0

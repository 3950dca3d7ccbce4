"""Blocking, features, evaluation, ranking, sampling and matching on small tables."""

import pytest
from pyspark.sql import functions as F

from entlink.operators import blocking as B
from entlink.operators import evaluation as E
from entlink.operators import export as O
from entlink.operators import ranking as R
from entlink.operators import sampling as S
from entlink.operators.encoder import HashingEncoder, encode, with_bank
from entlink.operators.export import as_text, lists
from entlink.operators.features import FEATURES, check_finite, pair_features
from entlink.operators.matching import Matcher, compare_arms, estimated_hours, promote, select_model, throughput
from entlink.plans.pipelines import fit_and_evaluate, matched
from entlink.sources import records as D
from entlink.sources.scratch import discover, fingerprint, read_json, write_json

# One bakery in two sources, under one roof with another unit; its twin in another country; a shop without an address.
BAKERY = [
    (1, "S1-40", "Nordlicht Bakery Limited", "7 Harbour Avenue, Flat 9c, 20457", "Norway", 40),
    (2, "S2-41", "Nordlicht Bakery Ltd", "7 Harbour Ave, Flat 4, 31118", "Norway", 41),
    (3, "S3-42", "Nordlicht Bakery Ltd", "7 Harbour Ave, Flat 4, 31118", "Chile", 42),
]
SHOP = (1, "S1-43", "Kelp & Co", None, "Norway", 43)
SCHEMA = "source int, entity_id string, business_name string, business_address string, country string, ord long"


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_features_of_a_pair(spark):
    prep = B.prepared(records(spark, [*BAKERY, SHOP]))
    s1, others = prep.where("source = 1"), prep.where("source > 1")
    pairs = B.block_candidates(s1, others)
    assert [(r.s1, r.cand) for r in pairs.collect()] == [("S1-40", "S2-41")]
    row = pair_features(pairs, s1, others).first()
    assert (row.core_name_exact, row.name_exact, row.unit_equal, row.unit_conflict, row.country_equal, row.address_missing) == (1, 0, 0, 1, 1, 0)
    # numbers: 7, 9c and 20457 against 7, 4 and 31118
    assert row.number_jaccard == pytest.approx(1 / 5) and row.number_disjoint == 0 and row.name_token_count == 3
    check_finite(pair_features(pairs, s1, others))
    with pytest.raises(ValueError):
        check_finite(pair_features(pairs, s1, others).withColumn("name_exact", F.lit(float("nan"))))


@pytest.mark.parametrize("hot", [100_000, 2])
def test_keys_of_too_many_owners_and_of_too_many_rows(spark, hot):
    """Owners beyond the cap end a key; rows of the other sources never do, they are only dealt to more tasks."""
    owners = [(1, f"S1-{i}", "Fjord Ferry Lines", "pier 3", "Norway", i) for i in range(5)]
    rows = [(2, f"S2-{i}", "Fjord Ferry Lines", "quay 8", "Norway", 100 + i) for i in range(9)]
    prep = B.prepared(records(spark, owners + rows))
    s1, others = prep.where("source = 1"), prep.where("source > 1")
    assert B.candidate_pairs(B.block_index(B.keyed(s1), 4), B.keyed(others), hot).count() == 0
    assert B.candidate_pairs(B.block_index(B.keyed(s1), 5), B.keyed(others), hot).count() == 45


def test_no_country_gives_no_keys(spark):
    rows = [(1, "S1-1", "Alpha Company Name", "1 Some Long Street", "", 1), (2, "S2-1", "Alpha Company Name", "1 Some Long Street", None, 2)]
    assert B.keyed(B.prepared(records(spark, rows))).count() == 0


def test_macro_f05(spark):
    """Four records: one with two of three targets found and one wrong, one missed, one rightly empty, one wrongly not."""
    counts = spark.createDataFrame([("p", 3), ("q", 1), ("r", 0), ("t", 0)], "s1 string, n_true long")
    pairs = spark.createDataFrame([("p", "a", 1, 0.8), ("p", "b", 1, 0.7), ("p", "c", 0, 0.65), ("q", "d", 1, 0.3), ("t", "e", 0, 0.61)], "s1 string, cand string, label int, score double")
    row = E.macro(E.per_business(counts, pairs.where("score >= 0.6"))).first()
    first = 1.25 * 2 / (1.25 * 2 + 1 + 0.25)
    assert row.macro_f05 == pytest.approx((first + 0 + 1 + 0) / 4) and (row.correct, row.incorrect, row.missed, row.singletons, row.singletons_correct) == (2, 2, 2, 2, 1)
    best = E.best_threshold(E.tune(counts, pairs, E.threshold_grid())).first()
    # from 0.7 on only the two right pairs of p are left
    assert best.threshold == pytest.approx(0.7) and best.macro_f05 == pytest.approx((2.5 / 2.75 + 0 + 1 + 1) / 4)


def test_old_against_new_by_country(spark):
    counts = spark.createDataFrame([("p", 1, "x"), ("q", 1, "x"), ("r", 0, "y")], "s1 string, n_true long, country string")
    old = spark.createDataFrame([("p", "a", 1), ("r", "b", 0)], "s1 string, cand string, label int")
    new = spark.createDataFrame([("p", "a", 1), ("q", "c", 1)], "s1 string, cand string, label int")
    got = {(r.country, r.model): (r.macro_f05, r.change) for r in E.compare_by_country(counts, {"old": old, "new": new}).collect()}
    assert got == {("x", "old"): (0.5, 0.0), ("x", "new"): (1.0, 0.5), ("y", "old"): (0.0, 0.0), ("y", "new"): (1.0, 1.0)}


def test_recall_without_truth_is_one(spark):
    counts = spark.createDataFrame([("a", 0)], "s1 string, n_true long")
    ranked = spark.createDataFrame([], "s1 string, cand string, label int, rank int")
    assert [r.recall for r in E.recall_report(counts, ranked, (10,)).collect()] == [1.0]


def test_hybrid_and_fusion(spark):
    df = spark.createDataFrame([([20, 21, 22, 23], [30, 20, 31, 32, 33])], "a array<int>, b array<int>")
    assert df.select(R.hybrid(F.col("a"), F.col("b"), 6).alias("h")).first().h == [20, 21, 22, 30, 31, 32]
    first = spark.createDataFrame([("q", "k", 1), ("q", "l", 2), ("q", "m", 3)], "s1 string, cand string, rank int")
    second = spark.createDataFrame([("q", "m", 1), ("q", "n", 2)], "s1 string, cand string, rank int")
    got = R.reciprocal_rank_fusion([first, second], 3).orderBy("rank").collect()
    assert [r.cand for r in got] == ["m", "k", "l"] and got[0].score == pytest.approx(1 / 63 + 1 / 61)


def test_lists_keep_empty_rows_and_rules_hold(spark):
    rec = records(spark, [*BAKERY, SHOP])
    out = matched(rec, threshold=0.1)
    assert {r.s1: (r.candidates, r.matches) for r in as_text(out).collect()} == {"S1-40": ("S2-41", "S2-41"), "S1-43": ("", "")}
    assert E.violations(rec.where("source = 1"), out, rec).count() == 0
    broken = out.withColumn("matches", F.array(F.lit("S2-7")))
    assert {r.rule for r in E.violations(rec.where("source = 1"), broken, rec).collect()} == {"match_not_candidate"}
    ranked = spark.createDataFrame([("S1-40", "S2-9", 0.9), ("S1-40", "S2-1", 0.5)], "s1 string, cand string, score double")
    assert lists(rec.where("source = 1"), ranked, 0.7, "rank").where("s1 = 'S1-40'").first().candidates == ["S2-9", "S2-1"]


def numbered(spark, n):
    return spark.range(n).select(F.col("id").alias("place"), F.concat(F.lit("S1-"), "id").alias("s1"), F.transform(F.sequence(F.lit(0), F.col("id") % 3), lambda x: F.concat(F.lit("S2-"), x)).alias("candidates"), F.array(F.lit("S2-0")).alias("matches"))


def test_shards_are_written_merged_and_checked(spark, tmp_path):
    path, rows = f"file://{tmp_path}/s", numbered(spark, 23)
    O.write_shards(rows, path, 10)
    merged = O.merge_shards(spark, path, 10)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, rows.collect()))
    assert {r["size"]: r.n for r in O.candidate_histogram(merged).collect()} == {1: 8, 2: 8, 3: 7}
    text = sorted((tmp_path / "s/candidates/shard=1").glob("*.csv"))
    assert len(text) == 1 and text[0].read_text().splitlines()[:2] == ["place\ts1\tcandidates", "10\tS1-10\tS2-0,S2-1"]
    text[0].write_text("\n".join(text[0].read_text().splitlines()[:-1]))
    (tmp_path / f"s/candidates/shard=1/.{text[0].name}.crc").unlink()
    with pytest.raises(ValueError, match="rows of candidates differ"):
        O.merge_shards(spark, path, 10)


def test_a_shard_that_is_missing_is_written_and_no_other(spark, tmp_path):
    path, rows = f"file://{tmp_path}/s", numbered(spark, 30)
    O.write_shards(rows.where("place < 10 or place >= 20"), path, 10)
    with pytest.raises(ValueError, match="missing"):
        O.merge_shards(spark, path, 10)
    before = {p: p.read_bytes() for p in (tmp_path / "s/candidates/shard=0").glob("*.csv")}
    O.write_shards(rows, path, 10)
    assert O.merge_shards(spark, path, 10).count() == 30 and before == {p: p.read_bytes() for p in (tmp_path / "s/candidates/shard=0").glob("*.csv")}
    other = f"file://{tmp_path}/o"
    O.write_shards(rows.where("place <> 13"), other, 10)
    with pytest.raises(ValueError, match="follow"):
        O.merge_shards(spark, other, 10)


def test_import_by_country(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    s1 = spark.createDataFrame([("S1-1", "x", 7), ("S1-2", "x", 3), ("S1-3", "", 5)], "entity_id string, country string, ord long")
    rows = spark.createDataFrame([("S1-1", ["a", "b"], ["b"]), ("S1-2", [], []), ("S1-3", ["c"], [])], "s1 string, candidates array<string>, matches array<string>")
    own = {c: (rows.join(s1.where(F.col("country") == c).select(F.col("entity_id").alias("s1")), "s1"), s1.where(F.col("country") == c)) for c in ("x", "")}
    O.import_country(*own["x"], "x", path)
    with pytest.raises(ValueError, match="differ in number"):
        O.in_input_order(spark, path, s1)
    O.import_country(*own["x"], "x", path)
    O.import_country(*own[""], "", path)
    assert O.completed(spark, path) == ["", "x"] and [r.s1 for r in O.in_input_order(spark, path, s1).collect()] == ["S1-2", "S1-3", "S1-1"]
    for bad in (rows.withColumn("matches", F.array(F.lit("z"))), rows.withColumn("candidates", F.array(F.lit("b"), F.lit("b"))), rows.withColumn("candidates", F.transform(F.sequence(F.lit(1), F.lit(21)), lambda x: x.cast("string")))):
        with pytest.raises(ValueError, match="rules"):
            O.import_country(bad, s1, "x", path)
    with pytest.raises(ValueError, match="records differ"):
        O.import_country(rows.where("s1 <> 'S1-1'"), s1, "x", path)


def test_small_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    write_json(spark, {"b": 1, "a": [2]}, f"{base}/one/facts.json")
    write_json(spark, {"b": 2}, f"{base}/one/facts.json")
    write_json(spark, {}, f"{base}/two/facts.json")
    write_json(spark, {}, f"{base}/two/more.json")
    assert read_json(spark, f"{base}/one/facts.json") == {"b": 2} and not list(tmp_path.rglob("*.tmp"))
    assert discover(spark, [base], "facts.json", ("more.json",)).endswith("/two")
    with pytest.raises(FileNotFoundError):
        discover(spark, [base], "facts.json")
    with pytest.raises(FileNotFoundError):
        discover(spark, [f"{base}/nowhere"], "facts.json")
    prints = [fingerprint(spark, f"{base}/one"), fingerprint(spark, f"{base}/two"), fingerprint(spark, f"{base}/one", {"k": 1})]
    assert len(set(prints)) == 3 and fingerprint(spark, f"{base}/one") == prints[0]


def test_diagnostics(spark, tmp_path):
    tuned = spark.createDataFrame([(0.2, 0.5), (0.1, 0.4)], "threshold double, macro_f05 double")
    held = spark.createDataFrame([("a", "b", "train", 1, 0.5), ("c", "d", "tune", 0, 0.25)], "s1 string, cand string, split string, label int, score double")
    O.write_diagnostics(tuned, held, f"file://{tmp_path}/d")
    lines = {n: [x for f in sorted((tmp_path / "d" / n).glob("*.csv")) for x in f.read_text().splitlines()] for n in ("thresholds", "heldout_pair_scores")}
    assert lines["thresholds"] == ["threshold\tmacro_f05", "0.1\t0.4", "0.2\t0.5"] and "c\td\ttune\t0\t0.25" in lines["heldout_pair_scores"] and not any(x.startswith("a\t") for x in lines["heldout_pair_scores"])


def test_truth_checks(spark):
    s1 = records(spark, BAKERY[:1])
    good = spark.createDataFrame([("S1-40", "S2-41")], "s1 string, target string")
    D.check_truth(s1, good)
    with pytest.raises(ValueError):
        D.check_truth(s1, good.union(spark.createDataFrame([("S1-43", "S2-41")], "s1 string, target string")))
    with pytest.raises(KeyError):
        D.lookup(spark.createDataFrame([("no",)], "entity_id string"), s1, "entity_id")


def test_tsv_round_trip(spark, tmp_path):
    rows = records(spark, [(1, "S1-1", 'A "quoted" name', "NA", "", 1), (1, "S1-2", "", "line\nend", "US", 2)]).select(*D.COLUMNS)
    for kind in ("none", "gzip"):
        D.write_tsv(rows, str(tmp_path / kind), kind)
        assert sorted(map(tuple, D.read_records(spark, str(tmp_path / kind)).collect())) == sorted(map(tuple, rows.collect()))


def test_split_and_samples(spark):
    df = spark.range(400).select(F.concat(F.lit("S1-"), "id").alias("entity_id"), (F.col("id") % 2).alias("g"))
    sizes = {(r.g, r.split): r["count"] for r in S.stratified_split(df, ["g"]).groupBy("g", "split").count().collect()}
    assert sizes == {(g, s): n for g in (0, 1) for s, n in (("train", 150), ("tune", 25), ("evaluation", 25))}
    plain = {}
    for r in df.withColumn("p", S.priority(2026)).collect():
        plain.setdefault(r.g, []).append((r.p, r.entity_id))
    want = {e: ("train" if k + 0.5 <= 150 else "tune" if k + 0.5 <= 175 else "evaluation") for own in plain.values() for k, (_, e) in enumerate(sorted(own))}
    assert {r.entity_id: r.split for r in S.stratified_split(df, ["g"]).collect()} == want
    drawn = S.training_pool(spark.createDataFrame([], "target string"), spark.createDataFrame([], "cand string"), df.withColumnRenamed("g", "source"), 3, 2026)
    assert sorted(r.entity_id for r in drawn.collect()) == sorted(e for own in plain.values() for _, e in sorted(own)[:3])
    old = S.bottom_k(df, 10, 1)
    assert S.bottom_k(df, 400, 2, exclude=old).join(old, "entity_id").count() == 0
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, S.bottom_k(df.repartition(7), 10, 1).collect()))


def test_pareto(spark):
    rows = spark.createDataFrame([("a", 0.9, 10.0), ("b", 0.8, 5.0), ("c", 0.8, 6.0), ("d", 0.9, 10.0)], "n string, macro_f05 double, seconds double")
    assert sorted(r.n for r in R.pareto(rows).collect()) == ["a", "b", "d"]
    many = spark.range(400).select((F.col("id") * 37 % 53 / 53).alias("macro_f05"), (F.col("id") * 29 % 41).cast("double").alias("seconds")).cache()
    points = [tuple(r) for r in many.collect()]
    want = sorted(p for p in points if not any(q[0] >= p[0] and q[1] <= p[1] and q != p for q in points))
    assert sorted(map(tuple, R.pareto(many).collect())) == want


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = [(r.v, r.n) for r in D.with_dense_id(df, ["v"], "n").collect()]
    assert sorted(n for _, n in got) == list(range(1000)) and [v for v, _ in sorted(got, key=lambda x: x[1])] == sorted(v for v, _ in got)


def learnable(spark, n=80):
    rows = [(f"S1-{i}", f"S2-{i}", i % 2, i % 3 > 0, *[float(i % 2) if k == 2 else float(i % 3) for k in range(len(FEATURES))]) for i in range(n)]
    return spark.createDataFrame(rows, "s1 string, cand string, label int, in_baseline boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def test_matcher_learns_saves_and_guards(spark, tmp_path):
    pairs = learnable(spark)
    matcher = Matcher.fit(pairs, rounds=20)
    assert matcher.score(pairs).where("(score > 0.5) <> (label = 1)").count() == 0
    again = Matcher.fit(pairs.repartition(7), rounds=20)
    assert again.trees.plain() == matcher.trees.plain()
    matcher.threshold = 0.42
    matcher.save(f"file://{tmp_path}/m")
    loaded = Matcher.load(f"file://{tmp_path}/m")
    assert loaded.threshold == 0.42 and sorted(map(tuple, loaded.score(pairs).collect())) == sorted(map(tuple, matcher.score(pairs).collect()))
    with pytest.raises(ValueError):
        Matcher.load(f"file://{tmp_path}/m", FEATURES[:-1])
    for bad in (pairs.where("label = 1"), pairs.limit(0)):
        with pytest.raises(ValueError):
            Matcher.fit(bad)
    with pytest.raises(Exception, match="not finite"):
        Matcher.fit(pairs.withColumn("name_exact", F.lit(float("nan"))))
    assert Matcher.fit(pairs, rounds=2, train_pairs=60).score(pairs).count() == 80
    truth = pairs.where("label = 1").select("s1", F.col("cand").alias("target"))
    counts = pairs.select("s1", F.col("label").cast("long").alias("n_true"))
    _, report = fit_and_evaluate(pairs.drop("label"), truth, counts, counts.select("s1", F.lit("US").alias("country")), rounds=20)
    assert report.first().macro_f05 == 1.0


def test_arms_are_tuned_and_selected_before_evaluation(spark):
    pairs = learnable(spark, 120)
    names = F.array(*[F.lit(x) for x in ("train", "train", "train", "tune", "evaluation")])
    split = pairs.select("s1", F.col("label").cast("long").alias("n_true"), F.element_at(names, (F.floor(F.substring("s1", 4, 9).cast("int") / 2) % 5).cast("int") + 1).alias("split"))
    weak = tuple(f for f in FEATURES if f != FEATURES[2])
    best, report, scored = compare_arms(pairs, split, {"weak": (weak, F.lit(True)), "all": (FEATURES, F.lit(True)), "base": (FEATURES, F.col("in_baseline"))}, rounds=20)
    assert best == "base" and report["all"]["macro_f05"] == report["base"]["macro_f05"] == 1.0 > report["weak"]["macro_f05"]
    assert report["base"]["evaluation_f05"] == 1.0 and "evaluation_f05" not in report["all"] and scored.where("split = 'train'").count() == 0


def test_throughput(spark):
    rec = records(spark, [(1, f"S1-{i:03}", "a", "b", "c", i) for i in range(30)])
    got = throughput(rec, lambda part: part.withColumn("n", F.length("business_name")), rows=25, part=10)
    assert (got["rows"], got["parts"]) == (25, 3) and got["rows_per_second"] > 0


def test_gate():
    assert estimated_hours(3600, 1.0) == pytest.approx(3.35)
    good = promote({"macro_f05": 0.9}, {"macro_f05": 0.8}, 3600, 1.0, 4)
    assert good["promoted"] and not promote({"macro_f05": 0.8}, {"macro_f05": 0.8}, 3600, 1.0, 4)["promoted"]
    assert select_model({"a": {"macro_f05": 1}, "b": {"macro_f05": 1}}) == "b"


def test_encoder_and_bank(spark):
    class Counting(HashingEncoder):
        pass

    df = spark.createDataFrame([("alpha",), ("beta",), ("alpha",), (None,)], "name string")
    vectors = {r.name: r.vector for r in encode(df, Counting(16), "name").collect()}
    assert sum(x * x for x in vectors["alpha"]) == pytest.approx(1, abs=1e-5) and set(vectors[None]) == {0.0}
    bank = spark.createDataFrame([("alpha", [9.0])], "name string, vector array<float>")
    got = {r.name: r.vector for r in with_bank(df, bank, HashingEncoder(16)).collect()}
    assert got["alpha"] == [9.0] and got["beta"] == vectors["beta"] and len(got) == 2

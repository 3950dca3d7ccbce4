"""Text functions against plain Python forms of their definitions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from entlink.functions import text as X
from entlink.functions import vectors as V

# Texts and their folded words, written out by hand.
FOLDED = {
    "Weiß & Söhne GmbH": "weiss söhne gmbh", "ÎLE DE RÉ": "île de ré", "ﬂoor ④ ¾": "floor 4 3 4", "Ｃａｆé９": "café9", "under_score": "under score",
    "हिंदी 7": "ह द 7", "ΛΟΓΟΣ": "λογοσ", "Ŀlull": "l lull", "ŉ": "ʼn", "e\u0301te\u0301": "été", "a\u0300\u0301": "à", "": "", "  \t\n": "", "Łódź Œuvre Þór": "łódź œuvre þór", "İ": "i",
}
UNITS = {
    "Flat 12b": "12b", "APT. 3": "", "apt: 3": "3", "Suite No 44": "44", "ste#ab_1": "ab_1", "apartment - 6": "6", "unit no. : 5": "5", "flats 3": "s", "reunite 3": "", "x_unit 3": "", "unit": "", "Unité 2": "é",
    "tower 2, unit 9, flat 1": "9",
}


def test_fold(spark):
    df = spark.createDataFrame([(t,) for t in FOLDED] + [(None,)], "t string")
    assert {r.t: r.n for r in df.select("t", X.norm(F.col("t")).alias("n")).collect()} == FOLDED | {None: ""}


def test_plain_letters_fold_alike_on_both_paths(spark):
    """Each character that takes the short path, alone and beside others, folds as Unicode says."""
    import re

    chars = [c for c in map(chr, range(0x250)) if re.match(X.PLAIN, c)]
    texts = [*chars, *[a + b for a, b in zip(chars, chars[1:], strict=False)], "".join(chars)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.f == unicodedata.normalize("NFKC", r.t).casefold() for r in df.select("t", X.fold(F.col("t")).alias("f")).collect())


def test_address_words(spark):
    df = spark.createDataFrame([("12 Main Road, null Suite 3",)], "t string")
    assert df.select(X.address_words(X.fold(F.col("t"))).alias("w")).first().w == ["12", "main", "rd", "ste", "3"]


def test_unit_id(spark):
    df = spark.createDataFrame([(t,) for t in UNITS], "t string")
    assert {r.t: r.u for r in df.select("t", X.unit_id(X.fold(F.col("t"))).alias("u")).collect()} == UNITS


@pytest.mark.parametrize("text", ["", "ab", "abc", "abcabc", "añb c", "😀ab😀ab"])
def test_grams(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert sorted(df.select(X.grams(F.col("t")).alias("g")).first().g) == sorted({text[i : i + 3] for i in range(len(text) - 2)})


def test_numbers_are_not_anchored(spark):
    assert sorted(spark.createDataFrame([("3b2 x7 12",)], "t string").select(X.number_words(F.col("t")).alias("n")).first().n) == ["12", "2", "3b", "7"]


def test_set_similarities(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], []), (["a"], []), (["a"], ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [(round(r.j, 6), round(r.c, 6)) for r in df.select(X.jaccard(F.col("a"), F.col("b")).alias("j"), X.containment(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [(0.333333, 0.5), (0, 0), (0, 0), (0.333333, 1)]


def test_lists_and_views(spark):
    df = spark.createDataFrame([(" S2-1 ,,S3-2 ", "Café  X", None)], "l string, n string, a string")
    row = df.select(X.parse_list(F.col("l")).alias("l"), X.encoder_view(F.col("n"), F.col("a")).alias("v"), X.is_blank(F.col("a")).alias("b")).first()
    assert row.l == ["S2-1", "S3-2"] and row.v == "query: business name: Café X; address: " and row.b


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0]


def test_codes_of_trigrams_are_equal_where_the_texts_are(spark):
    texts = ["abcabd", "a😀b😀c", "ßéà ßé", "😀😀😀", "ab", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", X.grams(F.col("t")).alias("g")).select("i", "g", X.gram_codes(F.col("g")).alias("c"))
    for r in df.collect():
        assert r.c == [(ord(g[0]) << 42) + (ord(g[1]) << 21) + ord(g[2]) for g in r.g] and len(set(r.c)) == len(r.g)

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "ga", "do") for b in ("ra", "ti", "no", "su") for c in ("n", "st", "ly", "é")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact copies, near copies, shared passages, repeats, nulls, empty and odd texts."""
    rng = random.Random(5)
    rows = []
    passage = text(rng, 60)
    for i in range(60):
        rows.append((i, text(rng, rng.choice([1, 3, 8, 40, 150, 400]))))
    for i in range(60, 72):
        rows.append((i, rows[i - 40][1]))
    for i in range(72, 84):
        words = rows[i - 55][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words)))
    for i in range(84, 92):
        rows.append((i, text(rng, 20) + " " + passage + " " + text(rng, 20)))
    rows += [(92, None), (93, ""), (94, "   \n "), (95, "ab " * 300), (96, "ñ" * 200), (97, "x"), (98, None), (99, ""), (100, text(rng, 20_000)), (101, "<|endoftext|> a  b\t\tc  d \n e\n\n\nf ")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns, as a caller's table may have."""
    return spark.createDataFrame([(i, t, "key", 7) for i, t in corpus], "doc_id long, text string, key string, n int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows = [(i, t.lower() if t else t, "en", f"src{i % 20}", len(t or "")) for i, t in corpus if i != 101]
    items = [(1, rows[3][1]), (2, " ".join((dict((r[0], r[1]) for r in rows)[100] or "").split()[500:530])), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{base}/benchmark.parquet")
    spark.createDataFrame([(r[0], r[0] % 2) for r in rows if r[0] % 3], "doc_id long, quality int").write.parquet(f"file://{base}/labels.parquet")
    return f"file://{base}", [(r[0], r[1]) for r in rows], items

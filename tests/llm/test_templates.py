"""Templates: runs of any length, windows at one shift, slots both ways, and recall of planted questions."""

import random
from pathlib import Path

import pytest

from entlink.llm import op8_templates as T

DATA = Path("/root/testdata/sf0.01")


def found(spark, docs, items):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in T.contaminated(df, bench).collect()}


def test_very_long_runs_of_names_and_numbers(spark):
    item = "the old river runs slowly past a quiet mill and seven grey stones by the bridge"
    runs = ["Abc " * 20_000, "1," * 20_000 + "1", "1.5 kg " * 20_000, "A\n" * 20_000, "aB " * 20_000, "Ab. " * 20_000]
    docs = [(i, f"{run}{item} {run}") for i, run in enumerate(runs)]
    assert found(spark, docs, [(1, item)]) == {(i, 1) for i in range(len(runs))}


def test_scattered_windows_are_no_copy(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    words = item.split()
    scattered = " and so on with quite other things in between ".join(" ".join(words[i : i + 5]) for i in range(16))
    inserted = " ".join([*words[:10], "well", "then", *words[10:]])
    items, docs = [(1, item)], [(1, scattered), (2, "before it " + inserted + " after it"), (3, item + " " + scattered)]
    assert found(spark, docs, items) == {(3, 1)}  # an insertion breaks four of sixteen windows
    longer = item + " " + " ".join(reversed(words))
    assert found(spark, [(2, "x " + longer.replace("ten eleven", "ten well then eleven"))], [(1, longer)]) == {(2, 1)}


def test_slots_map_both_ways(spark):
    item = "then we met Ann and saw Bob near the mill, and later on Ann gave Bob the bread while Carl sang for Dora"
    one = item.replace("Ann", "Eve").replace("Bob", "Eve").replace("Carl", "Eve").replace("Dora", "Eve")
    two = item.replace("Ann", "Eve").replace("Bob", "Finn").replace("Carl", "Gus").replace("Dora", "Hal")
    assert found(spark, [(1, one), (2, two)], [(1, item)]) == {(2, 1)}


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_recall_of_planted_questions(spark):
    """Items with other numbers and people, put into clean documents: at least 0.9 are found, and nothing else."""
    import duckdb

    rng = random.Random(8)
    names = ["Arlo", "Bettina", "Cosmo", "Dagmar", "Edwin", "Fiona Grey", "Gustav", "Helga", "Ivo Marsh", "Judith"]
    frames = [
        "{A} buys {n} pens and {m} books for {B}. How much does {A} pay if each pen costs {k} dollars and each book costs {n} dollars more than that?",
        "A train leaves the station at {n} km per hour. {A} boards it after {m} minutes and rides for {k} hours with {B}. How far does {A} travel in all?",
        "In the garden of {A} there are {n} trees. Every tree bears {m} apples, and {B} eats {k} of them each day. After how many days has {B} eaten all apples of {A}?",
        "{A} and {B} share {n} liters of juice. {A} drinks {m} liters in the morning, and {B} drinks {k} liters at noon. How many liters are left for the evening?",
    ]

    def fill(frame):
        a, b = rng.sample(names, 2)
        n, m, k = rng.sample(range(2, 900), 3)
        return frame.format(A=a, B=b, n=n, m=m, k=k)

    items = [(i, fill(f)) for i, f in enumerate(frames)]
    hosts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' WHERE length(text) BETWEEN 200 AND 3000 ORDER BY doc_id LIMIT 120").fetchall()]
    docs, want = [], set()
    for i, host in enumerate(hosts):
        if i % 2:
            at, k = rng.randrange(len(host.split())), rng.randrange(len(frames))
            words = host.split()
            docs.append((i, " ".join(words[:at]) + "\n\n" + fill(frames[k]) + "\n\n" + " ".join(words[at:])))
            want.add((i, k))
        else:
            docs.append((i, host))
    got = found(spark, docs, items)
    assert len(got & want) >= 0.9 * len(want) and not got - want

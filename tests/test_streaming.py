"""The stream equals the batch, takes up new files, and refuses other settings."""

import pytest

from entlink.operators import blocking as B
from entlink.streaming import incremental

ROW = "source int, entity_id string, business_name string, business_address string, country string, ord long"


def test_incremental_runs(spark, tmp_path):
    base = f"file://{tmp_path}"
    towns = ["Skagen", "Ribe", "Odense", "Aarhus", "Viborg", "Tønder", "Køge"]
    rows = [(2, f"S2-{i}", f"{towns[i % 7]} Sailmakers Inc", f"{20 + i % 7} {towns[i % 7]} quay road east", "Denmark", i) for i in range(20)]
    s1 = [(1, f"S1-{i}", f"{towns[i]} Sailmakers", f"{20 + i} {towns[i]} Quay Rd East", "Denmark", i) for i in range(7)]
    prep = B.prepared(spark.createDataFrame(s1, ROW))
    prep.write.parquet(f"{base}/s1")
    B.block_index(B.keyed(prep)).write.parquet(f"{base}/index")
    one, index, others = spark.read.parquet(f"{base}/s1"), spark.read.parquet(f"{base}/index"), spark.createDataFrame(rows, ROW)

    def go(settings):
        incremental.start(spark, f"{base}/in", others.schema, one, index, f"{base}/out", f"{base}/check", settings=settings).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{base}/out").select("s1", "cand", "score").collect()))

    others.where("ord < 10").coalesce(2).write.parquet(f"{base}/in")
    assert len(go({"cap": 30})) == 10
    others.where("ord >= 10").coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = go({"cap": 30})
    assert got == sorted(map(tuple, incremental.score_batch(others, one, index).collect())) and len(got) == 20
    assert go({"cap": 30}) == got
    with pytest.raises(ValueError):
        go({"cap": 31})

"""The stages in a row on a small table."""

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(0)
    good = [" ".join("w%d" % x for x in rng.integers(0, 10**5, 80)) for _ in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate([*good, good[3], good[3] + " more", "too short", None, good[5] + " mail a.b@c.example.org"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = now
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality"] == {*range(32), 34} and 30 not in ids["near_duplicates"] and set(range(30)) <= ids["near_duplicates"]
    assert all(df.columns == docs.columns for name, df in seen.items() if name != "packing")
    assert seen["mixing"].count() == seen["personal_data"].count() == len(ids["near_duplicates"])
    assert not seen["personal_data"].filter("text like '%@%'").count()
    pieces = seen["packing"].groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert {r["doc_id"] for r in pieces} == ids["near_duplicates"] and all(r["sum(length)"] == r["doc_tokens"] for r in pieces)

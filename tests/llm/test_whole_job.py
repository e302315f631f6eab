"""Results over whole tables where a bound, a unit or a greedy match once cut them."""

import math
from collections import Counter

import pytest


def test_thresholds_from_all_labelled_rows(spark):
    from pyspark.sql import functions as F

    from orbis.llm.quality import judge, quantiles, thresholds

    # Thresholds need about 440 good rows in each of four strata; all of them count.
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(55)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") < 500) | (F.col("id") % 3 == 0) & (F.col("id") >= 9000), "de").when((F.col("id") < 900) | (F.col("id") % 3 == 1) & (F.col("id") >= 9000), "fr").otherwise("en").alias("lang"), (F.col("id") % 17 == 0).alias("bad"))
    docs = docs.withColumn("text", F.concat(words, F.when(F.col("bad"), " ########").otherwise(" w0")))
    labels = docs.filter("doc_id < 9000").select("doc_id", (~F.col("bad")).cast("int").alias("quality"))
    found = {r["stratum"]: r for r in thresholds(docs, labels).collect()}
    held = Counter((r["lang"], r["bad"], r["design"]) for r in docs.withColumn("design", F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 0).filter("doc_id < 9000").collect())
    assert set(found) == {"de", "en"} and all(r["k"] == 0 and r["n"] == held[s, False, False] and r["bad"] == held[s, True, False] + held[s, True, True] for s, r in found.items())
    kept = judge(docs, labels, columns=["doc_id", "lang", "bad"])
    assert {(r["bad"], r["kept"]) for r in kept.filter("row.lang <> 'fr'").select("row.bad", "kept").distinct().collect()} == {(True, False), (False, True)}
    assert kept.filter("row.lang = 'fr' and not kept").count() == 0  # too few for the risk

    values = spark.range(500).select(F.lit("s").alias("stratum"), (F.col("id") % 2).cast("string").alias("rule"), F.floor(F.sqrt("id")).cast("double").alias("x"))
    shares, got = [0.004, 0.3, 0.5, 0.77, 1.0], {}
    for r in quantiles(values, shares).collect():
        got.setdefault(r["rule"], {})[r["step"]] = r["cutoff"]
    for rule in ("0", "1"):
        xs = sorted((float(int(k**0.5)) for k in range(500) if str(k % 2) == rule), reverse=True)
        assert got[rule] == {j: xs[max(1, math.ceil(s * len(xs))) - 1] for j, s in enumerate(shares)}


@pytest.mark.parametrize("weights", [[0.9, 0.1], [0.91] + [0.01] * 9, [0.5] + [0.5 / 19] * 19, [3**0.5, 2**0.5, 1.0, 0.001]])
def test_pfair_less_than_one_block_from_the_weights(spark, weights):
    from orbis.llm.mixing import schedule

    n = 6000
    share = [w / sum(weights) for w in weights]
    counts = spark.createDataFrame([(f"s{k:02}", int(n * p) + 40, w) for k, (w, p) in enumerate(zip(weights, share))], "source string, n long, w double")
    rows = sorted(schedule(counts, 1).collect(), key=lambda r: r["slot"])
    left = {r["source"]: r["n"] for r in counts.collect()}
    assert [r["slot"] for r in rows] == list(range(sum(left.values())))
    phase, done, before, t = 0, dict.fromkeys(left, 0), dict.fromkeys(left, 0), 0
    for r in rows:
        if r["phase"] != phase:
            phase, before, t = r["phase"], dict(done), 0
        t += 1
        assert r["nth"] == done[r["source"]] - before[r["source"]] and r["left"] == left[r["source"]] - before[r["source"]]
        done[r["source"]] += 1
        if r["phase"] == 0:
            assert all(abs(done[f"s{k:02}"] - t * p) < 1 + 1e-9 for k, p in enumerate(share))
    assert done == left and sum(r["phase"] == 0 for r in rows) >= n - 1


def test_pfair_zero_weight_goes_last(spark):
    from orbis.llm.mixing import schedule

    rows = sorted(schedule(spark.createDataFrame([("a", 5, 0.0), ("b", 7, 1.0), ("c", 3, 1.0)], "source string, n long, w double"), 1).collect(), key=lambda r: r["slot"])
    assert "".join(r["source"] for r in rows) == "bcbcbcbbbbaaaaa"


def test_pii_of_adjacent_numbers():
    from orbis.llm.pii import candidates, find, fitted

    wanted = {
        "555-123-4567 (555) 987-6543": [("phone", "555-123-4567"), ("phone", "(555) 987-6543")],
        "555-123-4567 / 555-987-6543": [("phone", "555-123-4567"), ("phone", "555-987-6543")],
        "4111.1111.1111.1111 5500.0000.0000.0004": [("card", "4111.1111.1111.1111"), ("card", "5500.0000.0000.0004")],
        "192[.]168[.]1[.]10 10[.]20[.]30[.]40": [("ip", "192[.]168[.]1[.]10"), ("ip", "10[.]20[.]30[.]40")],
        "555-123-4567 2024-05-01": [("phone", "555-123-4567")],
        "10.0.0.1 555-123-4567": [("ip", "10.0.0.1"), ("phone", "555-123-4567")],
        "+1 (843) 555-7672 170.106.47.21": [("ip", "170.106.47.21"), ("phone", "+1 (843) 555-7672")],
        "2024-05-01 2024-05-02 12 13": [],
    }
    for (text, want), (_, spans) in zip(wanted.items(), find(list(wanted), fitted())):
        assert [(k, text[s:e]) for k, s, e in spans] == want
    # However long a chain is, every run of groups of a kind's length is proposed: under five a group.
    text = " ".join(["555-123-4567"] * 400)
    found = set(candidates(text))
    assert all(("phone", k * 13, k * 13 + 12) in found for k in range(400)) and len(found) < 5 * 1200


def test_licenses_with_words_inserted(spark):
    from orbis.llm.licenses import TEMPLATES, scan, template_words

    words = template_words(TEMPLATES["mit"][0])
    n = len(words)
    inserted = lambda *cuts: " ".join(" ".join(words[a:b] + [f"x{k}" for k in range(9)]) for a, b in zip((0, *cuts), (*cuts, n)))
    texts = [inserted(n // 2), inserted(n // 3, 2 * n // 3), inserted(n // 2) + " " + inserted(n // 2), " ".join(words[n // 2 :] + ["x"] * 9 + words[: n // 2]), " ".join(words[: n // 3]), inserted(n // 2) + " " + " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"] if s["label"] == "mit" and not s["exact"]] for r in scan(docs).collect()}
    assert [len(got[k]) for k in range(6)] == [1, 1, 2, 0, 0, 2]
    assert [(s["first"], s["end"]) for s in got[2]] == [(0, n + 9), (n + 18, 2 * n + 27)]
    assert got[0][0]["score"] == (n - 4) / (n - 2) and got[1][0]["score"] == (n - 6) / (n - 2)

import math

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, "big" if i % 10 else "small", "alpha beta gamma delta " * (1 + i % 7), "clash") for i in range(4000)] + [(9001, "other", "unlisted source", ""), (9002, None, "x", ""), (9003, "big", None, ""), (9004, "big", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, share string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("absent", 0.0, 2)], "doc_source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_repeats_and_exact_sizes(spark, data):
    docs, targets = data
    chosen = M.mixture(docs, targets).cache()
    rows = {r["doc_id"]: r for r in chosen.collect()}
    assert len(rows) == chosen.count() and all(d < 9000 for d in rows)
    total = docs.where("doc_id < 9000").agg(F.sum(F.pandas_udf(M.token_counts(), "bigint")("text"))).first()[0]
    for source, share, most in (("big", 0.7, 1), ("small", 0.3, 4)):
        mine = [r for r in rows.values() if r["source"] == source]
        assert max(r["repeats"] for r in mine) <= most
        assert abs(sum(r["tokens"] * r["repeats"] for r in mine) - share * total) <= max(r["tokens"] for r in mine)
    # every small document gets its certain copies
    assert sum(r["source"] == "small" for r in rows.values()) == 400
    s = {r["source"]: r for r in M.shares(chosen, targets).collect()}
    assert abs(s["big"]["actual_share"] - 0.7) < 0.01 and s["absent"]["documents"] == 0
    assert sorted(map(tuple, M.mixture(docs.repartition(7), targets).collect())) == sorted(map(tuple, chosen.collect()))


def test_a_source_that_cannot_reach_its_target(spark, data):
    docs, _ = data
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], "doc_source string, target_share double, max_repeats int")
    chosen = M.mixture(docs, targets)
    assert {r["repeats"] for r in chosen.where("source = 'small'").select("repeats").distinct().collect()} == {2}
    assert M.mixture(docs.limit(0), targets).count() == 0 and M.mixture(docs, targets.limit(0)).count() == 0


def test_order_against_brute_force(spark, data):
    docs, targets = data
    sized = docs.where("doc_id < 9000 and source = 'big'").select("doc_id", F.pandas_udf(M.token_counts(), "bigint")("text").alias("n"), M._uniform(F.col("doc_id"), 7).alias("u")).collect()
    total = docs.where("doc_id < 9000").agg(F.sum(F.pandas_udf(M.token_counts(), "bigint")("text"))).first()[0]
    # the factor by bisection, then Pareto ranks one by one
    low, high = 0.0, 10.0
    for _ in range(80):
        k = (low + high) / 2
        low, high = (k, high) if sum(r["n"] * min(1.0, k * math.log1p(r["n"])) for r in sized) < 0.7 * total else (low, k)
    copies = {r["doc_id"]: min(1.0, low * math.log1p(r["n"])) for r in sized}
    assert len({round(c, 3) for c in copies.values()}) > 3  # chances differ inside a source
    sure = {d for d, c in copies.items() if c >= 1 - 1e-9}
    rest = 0.7 * total - sum(r["n"] for r in sized if r["doc_id"] in sure)
    rank = lambda r: (r["u"] / (1 - r["u"])) / (copies[r["doc_id"]] / (1 - copies[r["doc_id"]]))
    want, at = set(sure), 0
    for r in sorted((r for r in sized if r["doc_id"] not in sure), key=lambda r: (rank(r), r["doc_id"])):
        if at + r["n"] / 2 > rest:
            break
        want.add(r["doc_id"])
        at += r["n"]
    assert {r["doc_id"] for r in M.mixture(docs, targets).where("source = 'big'").collect()} == want


def test_expected_tokens_meet_the_target(spark, data):
    docs, _ = data
    small = docs.where("source = 'small'")
    targets = spark.createDataFrame([("small", 1.0, 2)], "doc_source string, target_share double, max_repeats int")
    few = small.limit(60).cache()
    sized = few.select("doc_id", "source", F.pandas_udf(M.token_counts(), "bigint")("text").alias("tokens"))
    want = targets.select(F.col("doc_source").alias("source"), F.lit(0.4).alias("share"), F.col("max_repeats").alias("most"))
    factor = M.expected_copies(sized, want).first()["factor"]
    rows = sized.collect()
    assert abs(sum(r["tokens"] * factor * math.log1p(r["tokens"]) for r in rows) - 0.4 * sum(r["tokens"] for r in rows)) < 1e-6

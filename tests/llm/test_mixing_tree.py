"""Shares over large trees, weights of 0, and sources with odd numbers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from wavefield.llm import mixing


def _leaves(rng, n):
    return {(rng.choice("ab"), rng.choice("xyz"), f"s/{i}"): rng.choice([0, 1, 5, 400, 90_000]) for i in range(n)}


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 1.0, 5.0])
def test_table_of_leaves_equals_the_tree_in_memory(spark, share):
    rng = random.Random(3)
    leaves = _leaves(rng, 300)
    weights = {("a",): 2.0, ("a", "x"): 0.0, ("b", "y"): 7.0, ("b", "y", "s/1"): 0.0, **{k: 0.0 for k in list(leaves)[:40]}}
    budget = share * sum(leaves.values())
    sizes = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "l1_ string, l2_ string, l3_ string, n_ long")
    got = {(r["l1_"], r["l2_"], r["l3_"]): r["allowed_"] for r in mixing.allowances(sizes, budget, weights, 2).collect()}
    expected = mixing.budgets(leaves, budget, weights, 2)
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) <= 1 for k in got)


def test_many_leaves(spark):
    sizes = spark.range(200_000).select(F.lit("web").alias("l1_"), (F.col("id") % 3).cast("string").alias("l2_"), F.col("id").cast("string").alias("l3_"), (F.col("id") % 100).alias("n_"))
    got = mixing.allowances(sizes, 1e6, {}, 1).agg(F.count("*"), F.sum("allowed_"), F.sum((F.col("allowed_") > 0).cast("int"))).first()
    assert got[0] == 200_000 and 800_000 <= got[1] <= 1_000_000 and got[2] == 198_000
    leaves = {("web", str(i % 3), str(i)): i % 100 for i in range(200_000)}
    start = time.time()
    assert sum(mixing.budgets(leaves, 1e6, {}, 1).values()) == got[1] and time.time() - start < 20


def test_cuts_too_large_to_broadcast(spark, monkeypatch):
    rows = [(i, "a few words of text " * (i % 7), "en" if i % 3 else None, f"src{i % 50}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = lambda: sorted((r["row"]["doc_id"], r["epoch"]) for r in mixing.mix(docs).collect())
    before = taken()
    monkeypatch.setattr(mixing, "PLAN_BYTES", 0)
    assert before and taken() == before


def test_odd_numbers_of_sources(spark):
    rows = [("src99999999999",), ("src99999999999999999999999999",), ("src0000007",), ("src8",), ("7",), ("src",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "source string").select(mixing.domain(F.coalesce("source", F.lit(mixing.NONE)))).collect()]
    assert got == ["web", "web", "curated", "web", "curated", "web", "web"]
    docs = spark.createDataFrame([(1, "one two", "en", "src99999999999")], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, share=1.0).count() == 1

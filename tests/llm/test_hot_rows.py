"""Rows that would gather in one task: hubs of near copies, rows without an id or with the same one; and columns in another case."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import exact_dedup, mixing, ngram_join, quality_gam, simhash
from test_operators import brute_components


def most_in_a_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_pairs_of_a_hub_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 50)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) if i < 60 else " ".join(base + [f"y{i}"]) for i in range(400)} | {1_000 + i: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = spark.createDataFrame([(300, i) for i in range(400) if i != 300] + [(1_000, 1_001)], "a long, b long").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in texts.items()}
    want = {(r["a"], r["b"]) for r in pairs.collect() if 100 * len(sets[r["a"]] & sets[r["b"]]) >= 80 * len(sets[r["a"]] | sets[r["b"]])}
    got = ngram_join.verified(pairs, docs)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert most_in_a_partition(ngram_join.verified(pairs, docs)) < len(want) / 2  # one task would hold them all
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert found == brute_components(list(texts.items()))


@pytest.mark.parametrize("key", [None, 7])
def test_mixing_spreads_rows_of_one_id(spark, key):
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, F.lit(key)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.col("id").alias("n"), F.lit("x").alias("sid"))
    placed = mixing.mixed(rows, block_rows=64).select("row.n", "source", "block", "slot", "position").collect()
    assert sorted(r["position"] for r in placed) == list(range(4_000)) and sorted(r["n"] for r in placed) == list(range(4_000))
    full = {}
    for r in placed:
        full[r["source"], r["block"]] = full.get((r["source"], r["block"]), 0) + 1
    assert max(full.values()) == 64 and sum(v < 64 for v in full.values()) <= 2
    ordered = mixing.in_mixed_order(rows, block_rows=64)
    assert ordered.columns == rows.columns and ordered.count() == 4_000 and most_in_a_partition(ordered) <= 1_000


def test_simhash_of_rows_without_an_id(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string"), F.repeat(F.lit(" more"), F.col("id").cast("int") % 7)).alias("text"))
    got = simhash.edited_pairs(rows).collect()
    lone = [r for r in got if r["doc_id"] is None]
    assert len(got) == 400 and len(lone) == 200 and all(r["near_next"] == 1.0 for r in lone)
    assert len({r["fingerprint"] for r in got}) > 150


def test_columns_in_another_case_or_with_odd_names(spark, sf):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, text + " more", "a"), (4, "other words here", None)], "Doc_ID long, Text string, Source string").selectExpr("*", "1 AS _gone", "2 AS gone", "Doc_ID AS component", "'x' AS hub", "3 AS salt", "4 AS `od.d`")
    assert sorted(r["Doc_ID"] for r in exact_dedup.drop_copies(docs).collect()) == [1, 3, 4]
    kept = ngram_join.keep_one(docs)
    assert sorted(r["Doc_ID"] for r in kept.collect()) == [1, 4] and kept.columns == docs.columns
    model = quality_gam.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert quality_gam.keep_good(docs, model).columns == docs.columns
    assert mixing.in_mixed_order(docs).count() == 4
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join"

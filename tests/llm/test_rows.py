"""Stages that keep one row of a group: repeated and null ids, odd columns; and the work of the n-gram join."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import components, exact_dedup, hot, ngram_join
from test_operators import brute_components, normal

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE + " w60"
OTHER = " ".join(f"v{i}" for i in range(40))


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(5, BASE, "a"), (5, OTHER, "b"), (3, OTHER, "c"), (None, "null twins " * 9, "d"), (None, "null twins " * 9, "e"), (None, BASE, "f"), (7, NEAR, "g"), (7, NEAR, "g"), (None, None, "h"), (8, "", "i"), (9, " ", "j"), (None, NEAR + " w61", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "text AS _recipe", "doc_id AS _row", "source AS `od.d``name`", "map(source, text) AS m")


def test_drop_copies_goes_by_rows(spark, repeated):
    got = exact_dedup.drop_copies(repeated)
    assert got.columns == repeated.columns
    kept = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
    assert sorted(normal(t) for _, t, _ in kept) == sorted({normal(r["text"]) for r in repeated.collect()})
    assert {(d, s) for d, t, s in kept if t == BASE} == {(5, "a")} and {(d, s) for d, t, s in kept if t == OTHER} == {(3, "c")}
    assert exact_dedup.drop_copies(repeated.limit(0)).count() == 0
    groups = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(repeated).collect()}
    base = [r for r in groups.values() if r["group_size"] == 2 and r["keep_id"] == 5]
    assert {(r["doc_id"], r["kept"]) for r in base} == {(5, True), (None, False)}
    assert any(r["doc_id"] is None and r["keep_id"] is None and r["kept"] and r["group_size"] == 2 for r in groups.values())


def test_keep_one_goes_by_rows(spark, repeated):
    got = ngram_join.keep_one(repeated)
    assert got.columns == repeated.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    empty = [k for k in kept if not k[2].strip()]
    assert len(empty) == 3  # nothing links with an empty set
    assert [k for k in kept if k[2].strip()] == [(False, 3, OTHER), (False, 5, BASE), (True, 0, "null twins " * 9)]
    classes = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in ngram_join.jaccard_classes(repeated).collect())
    assert (0, 5, 56) in classes and (5, 3, 36) in classes and (3, 3, 36) in classes and classes.count((7, 5, 57)) == 2 and (0, 0, 2) in classes


def test_stages_keep_the_columns(spark, sf, repeated):
    docs = repeated.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, data, sf).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, data, sf).count() == data.count()


def test_sets_that_share_an_id_are_told_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = ngram_join.jaccard_classes(docs, width=6)  # 32 even ids for all sets
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_family_rows_stay_few(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, passage + " " + " ".join(f"q{d}_{k}" for k in range(rng.randint(4, 40)))) for d in range(300)]
    rows += [(1000 + d, " ".join(w if rng.random() > 0.01 else f"z{rng.randint(0, 9999)}" for w in BASE.split())) for d in range(300)]
    seen = []
    plain = ngram_join._family_links
    monkeypatch.setattr(ngram_join, "_family_links", lambda family, docs: seen.append((family.count(), family.select("rep").distinct().count())) or plain(family, docs))
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)
    assert seen and seen[0][0] <= 3 * seen[0][1] <= 3 * len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (101, 101), (7, 7), (None, 3), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_with_group_spreads_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = {r["id"]: (r["n"], r["low"]) for r in hot.with_group(rows, groups, ["k"], "n", least=100, most=5).collect()}
    count = {r["k"]: (r["n"], r["low"]) for r in groups.collect()}
    assert got == {r["id"]: count[r["k"]] if r["k"] is not None else (None, None) for r in rows.collect()}

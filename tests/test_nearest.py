"""Pruned searches against plain loops, and how many pairs they compare."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import nearest


def clustered(rng, n, dims, spots=12, spread=0.15):
    x = rng.normal(size=(spots, dims))[rng.integers(0, spots, n)] + rng.normal(size=(n, dims)) * spread
    x[1], x[2] = x[0], x[0]
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, labels, first=0):
    rows = [(first + i, labels[i], v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")


@pytest.mark.parametrize("cell_rows", [30, 4_096])
def test_nearest_unit(spark, cell_rows):
    rng = np.random.default_rng(1)
    x = clustered(rng, 600, 12)
    labels = [rng.choice(["a", "b", None]) for _ in x]
    ask_at = list(range(0, 600, 9))
    asked = frame(spark, x[ask_at], ["z" if i % 4 == 0 else labels[i] for i in ask_at]).withColumn("vec_id", F.col("vec_id") * 9)
    rows = nearest.unit_rows(frame(spark, x, labels), "vec_id", "label")
    found, count = nearest.nearest_unit(nearest.unit_rows(asked, "vec_id", "label"), rows, 5, cell_rows)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["candidate"], r["score"]))
    u = {r["id"]: np.array(r["v"]) for r in rows.collect()}
    full = 0
    for r in asked.collect():
        names = [i for i in range(600) if labels[i] == r["label"]] if r["label"] in ("a", "b") else list(range(600))
        full += len(names)
        q = u[r["vec_id"]]
        near = sorted((-sum(a * b for a, b in zip(q.tolist(), u[i].tolist())), i) for i in names if i != r["vec_id"])[:5]
        assert [(k, c) for k, c, _ in sorted(got[r["vec_id"]])] == [(k + 1, i) for k, (_, i) in enumerate(near)]
        assert np.allclose([v for *_, v in sorted(got[r["vec_id"]])], [-v for v, _ in near], atol=1e-12)
    assert count.first()["compared"] <= (0.6 if cell_rows == 30 else 1) * full


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_best_by_label(spark, least):
    rng = np.random.default_rng(2)
    x = clustered(rng, 500, 16)
    labels = [str(i % 40) if i % 7 else None for i in range(500)]
    memory = nearest.unit_rows(frame(spark, x, labels), "vec_id", "label")
    asked = nearest.unit_rows(frame(spark, x[:50], labels), "vec_id", None)
    found, count = nearest.best_by_label(asked, memory, least, 25)
    score, want = x[:50] @ x.T, {}
    for q in range(50):
        for i in range(500):
            if score[q, i] >= least:
                want[q, labels[i]] = max(want.get((q, labels[i]), -1), score[q, i])
    got = {(r["query"], r["label"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert count.first()["compared"] < (0.5 if least == 0.8 else 1) * 50 * 500


def test_empty_sides(spark):
    x = clustered(np.random.default_rng(3), 5, 4)
    some = nearest.unit_rows(frame(spark, x, ["a"] * 5), "vec_id", "label")
    for q, c in ((some.limit(0), some), (some, some.limit(0)), (some.limit(0), some.limit(0))):
        assert nearest.nearest_unit(q, c, 3)[0].count() == 0 and nearest.best_by_label(q, c, 0.5)[0].count() == 0
    assert nearest.nearest_unit(some, some, 9)[0].count() == 20


def test_palette_rings(spark):
    rng = random.Random(4)
    palette = [(k, [rng.randrange(256) if k % 3 else rng.randrange(40) for _ in range(3)]) for k in range(2_000)]
    seen, distinct = set(), []
    for k, c in palette:
        if tuple(c) not in seen:
            seen.add(tuple(c))
            distinct.append((k, c))
    wanted = {tuple(rng.randrange(256) for _ in range(3)) for _ in range(150)} | {(0, 0, 0), (255, 255, 255), (300, -5, 10)}
    best, count = nearest.nearest_palette(spark.createDataFrame(list(wanted), "r int, g int, b int"), spark.createDataFrame(distinct, "color_id long, c array<int>"), 6)
    got = {}
    for r in best.collect():
        got.setdefault((r["r"], r["g"], r["b"]), []).append((r["rank"], r["color_id"], round(r["distance"] ** 2)))
    for w in wanted:
        near = sorted((sum((a - b) ** 2 for a, b in zip(w, c)), k) for k, c in distinct)[:6]
        assert sorted(got[w]) == [(n, k, d) for n, (d, k) in enumerate(near, 1)]
    assert count.first()["compared"] < 0.3 * len(wanted) * len(distinct)
    few = nearest.nearest_palette(spark.createDataFrame([(1, 2, 3)], "r int, g int, b int"), spark.createDataFrame(distinct[:2], "color_id long, c array<int>"), 6)[0]
    assert few.count() == 2
    assert nearest.nearest_palette(spark.createDataFrame([], "r int, g int, b int"), spark.createDataFrame([], "color_id long, c array<int>"), 6)[0].count() == 0

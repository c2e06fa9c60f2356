"""Resampling, clustering and neighbour search against plain loops, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from compare import oracle_rows, spark_rows
from stepweave.llm import ann_codes, centroids, importance, queries
from stepweave.llm.textbytes import column_bytes


@pytest.mark.parametrize("name", ["op11_importance", "op12_centroids", "op13_neighbours"])
def test_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == oracle_rows(queries.ORACLES[name], sf)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(text, runs):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute_draw(docs, target, runs, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs_of(x, runs)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, x in docs:
        found = runs_of(x, runs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([d, len(words_of(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r, drawn.get(id(r))) for r in rows)


@pytest.mark.parametrize(("runs", "most"), [(1, 50_000), (3, 6), (2, 0)])
def test_draw_equals_a_plain_loop(spark, odd_docs, runs, most):
    target = spark.createDataFrame([("alpha5 beta7, Été",), (None,), ("",), ("one two three",)], "text string")
    got = importance.resampled(odd_docs, target, percent=70, runs=runs, buckets=50, least_words=3, seed=1, most=most)
    want = brute_draw([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [r["text"] for r in target.collect()], runs, 50, 3, 70, 1)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert importance.resampled(odd_docs.limit(0), target.limit(0)).count() == 0


def test_ranks_of_many_equal_rows(spark):
    rows = spark.range(1_000).selectExpr("cast(if(id < 700, 5, id) AS long) AS doc_id", "cast(if(id < 700, 7, id % 10) AS long) AS score")
    placed, n = importance.ranked(rows, "score", "doc_id")
    got = placed.orderBy("rank").collect()
    assert n == 1_000 and [r["rank"] for r in got] == list(range(1, 1_001))
    assert [(r["score"], r["doc_id"]) for r in got] == sorted(((r["score"], r["doc_id"]) for r in got), key=lambda x: (-x[0], x[1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 é日.\n-", max_size=30), max_size=6), st.integers(1, 4), st.integers(0, 3))
def test_payloads_compose(texts, runs, known):
    import pyarrow as pa

    scan = importance.Scanner([w.encode() for w in ["a", "é日", "9"][:known]])
    raw, off = column_bytes(pa.array(texts, pa.string()))
    row, crc, n = scan.features(raw, off, runs)
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert Counter(zip(row.tolist(), crc.tolist())) == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in runs_of(t, runs))


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * float(np.float64(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), j) for j, z in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, j, d in found:
        by[j] += d
    return Counter((i, j, d, by[j], by.total(), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def odd_vectors(rng, n, dims, size=1.0, kind=float):
    """Clusters, equal vectors, a third in one place, repeated and null ids, and rows that are left out."""
    spots = rng.normal(size=(5, dims)) * size
    x = spots[rng.integers(0, 5, n)] + rng.normal(size=(n, dims)) * size * 0.2
    x[: n // 3] = spots[0] + rng.normal(size=(n // 3, dims)) * size * 1e-3
    x[n // 3 : n // 3 + 9] = x[0]
    rows = [(int(i), [kind(np.float32(v)) for v in e]) for i, e in enumerate(x)]
    return rows + [(3, rows[3][1]), (3, rows[7][1]), (None, rows[1][1]), (4, rows[-1][1]), (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [None] + [1.0] * (dims - 1)), (906, [0.0] * dims), (907, [-0.0] * dims)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS row", "vec_id AS cluster", "embedding AS v", "1 AS n")


@pytest.mark.parametrize("size", [1.0, 3e5])  # the second needs whole numbers beyond what a double's products hold
def test_clusters_equal_a_plain_loop(spark, size):
    rows = odd_vectors(np.random.default_rng(3), 160, 6, size)
    got = centroids.clusters(frame(spark, rows), k=12, rounds=6, dims=6)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 12, 6, 6, 256, 2)


def test_clusters_of_few_vectors(spark):
    rows = odd_vectors(np.random.default_rng(4), 30, 6)
    for some in (rows[:1], rows[:4], rows[9:13] * 2):
        assert Counter(tuple(r) for r in centroids.clusters(frame(spark, some), dims=6).collect()) == brute_clusters(some, 40, 5, 6, 256, 2)
    for none in (frame(spark, rows).limit(0), frame(spark, [r for r in rows if r[0] in (900, 901, 902)])):
        assert centroids.clusters(none, dims=6).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(frame(spark, [(1, [1e300] * 6)]), dims=6).count()


def test_heaps_spare_scans(spark):
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(8, 16)) * 5
    rows = [(i, (spots[i % 8] + rng.normal(size=16) * 0.3).tolist()) for i in range(6_000)]
    found, _, scanned = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, rounds=8, dims=16)
    assert found.count() == scanned[0] == 6_000 and sum(scanned[1:]) < 0.5 * 8 * 6_000 and scanned[-1] < 600


def brute_neighbours(rows, k, every):
    good = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and math.isfinite(x) for x in e) and any(e) and len(e) == len(rows[0][1])]
    out = []
    for n, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        scored = []
        for m, (i, y) in enumerate(good):
            if m != n:
                total = 0.0
                for a, b in zip(x.tolist(), y.tolist()):
                    total += a * b
                scored.append((-total, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda v: (v[0], v[1], v[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize("cell_rows", [4_096, 40])
def test_neighbours_against_brute_force(spark, cell_rows):
    rows = odd_vectors(np.random.default_rng(6), 400, 24)
    got = Counter(tuple(r) for r in ann_codes.neighbours(frame(spark, rows), k=7, every=5, cell_rows=cell_rows).collect())
    want = brute_neighbours(rows, 7, 5)
    assert got.total() == want.total() and (got & want).total() >= 0.99 * want.total()


def test_neighbours_of_small_tables(spark):
    rows = odd_vectors(np.random.default_rng(7), 30, 8)
    for some in (rows[:1], rows[:6], [(0, rows[0][1])] * 3):
        assert Counter(tuple(r) for r in ann_codes.neighbours(frame(spark, some), every=2).collect()) == brute_neighbours(some, 20, 2)
    assert ann_codes.neighbours(frame(spark, rows).limit(0)).count() == 0
    assert ann_codes.neighbours(frame(spark, [(0, None), (20, [0.0] * 8)])).count() == 0


def test_recall_of_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    ids = rows["vec_id"].to_numpy()
    score = x[ids % 20 == 0] @ x.T
    score[ids[ids % 20 == 0][:, None] == ids[None, :]] = -np.inf
    want = {(q, ids[j]) for q, s in zip(ids[ids % 20 == 0], score) for j in np.argsort(-s)[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in ann_codes.neighbours(table).collect()}
    assert len(got & want) >= 0.99 * len(want)


def test_errors_stay_within_their_bounds():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(2_000, 64)), rng.normal(size=(50, 64))
    turn, c = ann_codes.rotation(64), np.zeros((1, 64))
    _, code, far, scale, error = ann_codes.coded(x, c, turn)
    bits = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    guess = (q @ turn.T / np.sqrt(len(turn))) @ bits.T * scale
    off = np.abs(guess - q @ x.T) / (error * np.linalg.norm(q, axis=1)[:, None])
    assert (off > 1).mean() < 0.005 and off.mean() > 0.05  # three deviations, and no idle slack
    *_, scored = ann_codes.best_of_block(q, np.full(50, np.nan), np.full(50, -1), x, code, scale, error, np.arange(2_000), c[0], turn, 20)
    assert scored < 0.5 * 50 * len(x)

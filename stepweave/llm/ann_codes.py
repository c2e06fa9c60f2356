"""Nearest neighbours by inner product through randomly rotated one-bit codes.

Index: every vector belongs to the nearest of a few cell centroids (k-means on at most SAMPLE rows, the documented bound; one cell for
CELL_ROWS rows, at most MAX_CELLS). What is left of it after the centroid is rotated at random into BITS dimensions, and the signs
are its code, packed eight to a byte. With a the inner product of the code's vector and the rotated rest's direction, the rest's product with
a query is estimated without bias as |rest| / a times the code's product with the rotated query, and the error stays below
|rest| |query| sqrt(1 - a^2) / a * ERRORS / sqrt(BITS - 1) but for a chance that falls off as a Gaussian's beyond ERRORS deviations. |rest| / a and
the factor of the error are kept beside each code.

Search: codes travel packed; a block's signs are unpacked once, and one matrix product gives the estimates of all its queries. Queries first
visit their best cell, where the best estimates are scored and give a kth score to beat. With the kth score found there they visit all other
cells that hold a vector close enough to their centroid to reach it: a cell is passed over only where its radius proves that it
can't. Whatever may reach the score to beat within its error is reranked exactly, the rest is left. Blocks hold at most BLOCK_ROWS
vectors of one cell and QUERY_ROWS queries, so a hot cell is spread over many tasks, and each block passes on ``k`` rows a query.
Data without clusters visits all cells: work is then queries times vectors, on codes of 32 bytes.

Defined cases: vectors that are null, zero, of another length than ``dims`` (the most frequent one if not given), or hold a null or
non-finite component take no part; ties go to the smaller id, null last; rows that repeat an id stay apart rows and only a query's own row
is left out; with fewer than ``k`` candidates all are found; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from stepweave.llm.sampling import bounded_sample
from stepweave.session import cut, discard

BITS, ERRORS = 256, 3.0
SAMPLE, CELL_ROWS, MAX_CELLS = 10_000, 4_096, 256
BLOCK_ROWS, QUERY_ROWS, MAX_TASKS = 8_192, 1_024, 4_096


def rotation(dims: int, bits: int = BITS) -> np.ndarray:
    """A random ``bits`` x ``dims`` matrix with orthonormal columns, always the same."""
    return np.linalg.qr(np.random.default_rng(1313).normal(size=(max(bits, dims), dims)))[0]


def cells(rows: DataFrame, dims: int, most: int) -> np.ndarray:
    """Cell centroids: a few rounds of k-means over a bounded sample on the driver."""
    x = np.array([r["e"] for r in bounded_sample(rows.select("row", "e"), ["row"], SAMPLE).select("e").collect()], float).reshape(-1, dims)
    if not len(x):
        return np.zeros((1, dims))
    c = x[np.random.default_rng(7).permutation(len(x))[:most]]
    for _ in range(8):
        own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def coded(x: np.ndarray, c: np.ndarray, turn: np.ndarray, errors: float = ERRORS) -> tuple[np.ndarray, ...]:
    """(cell, packed code, |rest|, |rest| / a, factor of the error) of each vector."""
    own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
    rest = x - c[own]
    far = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn.T
    a = np.abs(turned).sum(1) / (np.maximum(far, 1e-300) * np.sqrt(len(turn)))
    a = np.where(far > 0, a, 1.0)
    error = far * np.sqrt(np.maximum(1 - a * a, 0)) / a * errors / np.sqrt(len(turn) - 1)
    return own, np.packbits(turned > 0, axis=1), far, far / a, error


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    """A binary column as a matrix, a row each."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def _indexed(rows: DataFrame, c: np.ndarray, turn: np.ndarray, errors: float) -> DataFrame:
    """(row, vec_id, asks, vec, cell, code, far, scale, error)."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own, code, far, scale, error = coded(x, c, turn, errors)
            blob = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), blob(x), pa.array(own.astype(np.int32)), blob(code), pa.array(far), pa.array(scale), pa.array(error)], ["row", "vec_id", "asks", "vec", "cell", "code", "far", "scale", "error"])

    return rows.select("row", "vec_id", "asks", "e").mapInArrow(run, f"row long, vec_id {kind}, asks boolean, vec binary, cell int, code binary, far double, scale double, error double")


def _routed(queries: DataFrame, c: np.ndarray, radius: np.ndarray, first: bool) -> DataFrame:
    """(row, vec, least, home, cell): the best cell of each query, or all others that may hold a vector as good as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), "f8")
            reach = q @ c.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :] * (1 + 1e-9)
            if first:
                home = (q @ c.T + np.where(radius >= 0, 0, -np.inf)).argmax(1)
                at, to = np.arange(len(q)), home
            else:
                home = batch.column(3).to_numpy()
                least = batch.column(2).to_numpy(zero_copy_only=False)
                go = (radius >= 0)[None, :] & ~(reach < least[:, None])  # an unknown least lets all cells in
                go[np.arange(len(q)), home] = False
                at, to = np.nonzero(go)
            for lo in range(0, len(at), 4_096):
                part = pa.array(at[lo : lo + 4_096])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(part) for i in range(3)), pa.array(home[at[lo : lo + 4_096]].astype(np.int32)), pa.array(to[lo : lo + 4_096].astype(np.int32))], ["row", "vec", "least", "home", "cell"])

    return queries.select("row", "vec", "least", "home").mapInArrow(run, "row long, vec binary, least double, home int, cell int")


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of ``q`` and j of ``x``, added up component by component: equal vectors have equal products."""
    out = np.zeros(len(i))
    for d in range(q.shape[1]):
        out += q[i, d] * x[j, d]
    return out


def best_of_block(q: np.ndarray, least: np.ndarray, own: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, rows: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, product) of up to ``k`` vectors for each query, of equal products the first; and how many were scored.

    All estimates of some queries are one product of their rotated vectors with the signs of the codes. What may reach the floor is
    scored in single precision, and what then isn't clearly below the kth score in double precision, component by component.
    """
    near, size = q @ centre, np.sqrt((q * q).sum(1))
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    signs *= (scale / np.sqrt(len(turn))).astype(np.float32)[:, None]
    turned, x32, q32, error = (q @ turn.T).astype(np.float32), x.astype(np.float32), q.astype(np.float32), error.astype(np.float32)
    slack = 1e-5 * size * np.sqrt((x * x).sum(1).max())  # what single precision may be off by
    order = np.argsort(rows)
    spot = np.minimum(np.searchsorted(rows, own, sorter=order), len(rows) - 1)
    self_at = np.where(rows[order[spot]] == own, order[spot], -1)
    left, right, scored = [], [], 0
    for lo in range(0, len(q), 64):
        guess = turned[lo : lo + 64] @ signs.T
        guess += near[lo : lo + 64, None].astype(np.float32)
        here = np.arange(len(guess))
        mine = self_at[lo : lo + 64]
        guess[here[mine >= 0], mine[mine >= 0]] = -np.inf
        floor = least[lo : lo + 64].copy()
        for t in np.flatnonzero(np.isnan(floor)):
            floor[t] = -np.inf
            if len(x) > k + 1:
                top = np.argpartition(-guess[t], k)[:k]
                floor[t] = (x32[top] @ q32[lo + t]).min() - slack[lo + t]
        guess += size[lo : lo + 64, None].astype(np.float32) * error
        may = guess >= (floor - slack[lo : lo + 64]).astype(np.float32)[:, None]
        may &= guess > -np.inf
        for t in np.flatnonzero(may.any(1)):
            at = np.flatnonzero(may[t])
            score = x32[at] @ q32[lo + t]
            scored += len(at)
            if len(at) > k:
                at = at[score >= np.partition(score, -k)[-k] - 2 * slack[lo + t]]
            left.append(np.full(len(at), lo + t))
            right.append(at)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), scored
    i, j = np.concatenate(left), np.concatenate(right)
    score = products(q, x, i, j)
    by = np.lexsort((j, -score, i))
    i, j, score = i[by], j[by], score[by]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    nth = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return i[nth < k], j[nth < k], score[nth < k], scored


def _scanned(routed: DataFrame, index: DataFrame, c: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """(row, vec_id, score): up to ``k`` rows for each query and block, ties included whole by id."""
    kind = index.schema["vec_id"].dataType.simpleString()
    blocks = lambda rows, most: F.ceil(F.count("*") / most).cast("int")
    held = index.groupBy("cell").agg(blocks(index, BLOCK_ROWS).alias("parts"))
    asked = routed.groupBy("cell").agg(blocks(routed, QUERY_ROWS).alias("turns"))
    plan = cut(held.join(asked, "cell"))  # a row for each cell
    tasks = plan.agg(F.sum(F.col("parts") * F.col("turns"))).first()[0] or 1
    n = min(int(tasks), MAX_TASKS)
    deal = lambda rows, own, all_: rows.join(F.broadcast(plan), "cell").withColumn(own[0], F.expr(f"cast(pmod(xxhash64(row), {own[1]}) AS int)")).withColumn(all_[0], F.explode(F.expr(f"sequence(0, {all_[1]} - 1)")))
    left = deal(routed, ("turn", "turns"), ("part", "parts")).select("cell", "part", "turn", "row", "vec", "least").repartition(n, "cell", "part", "turn")
    right = deal(index, ("part", "parts"), ("turn", "turns")).select("cell", "part", "turn", "row", "vec_id", "vec", "code", "scale", "error").repartition(n, "cell", "part", "turn")
    keys = ["cell", "part", "turn"]

    def search(asks: pa.Table, block: pa.Table) -> pa.Table:
        names = ["row", "vec_id", "score"]
        if not asks.num_rows or not block.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], block.schema.field("vec_id").type), pa.array([], pa.float64())], names)
        whole = lambda t, name: t.column(name).combine_chunks()
        number = lambda t, name: whole(t, name).to_numpy(zero_copy_only=False)
        block = block.sort_by([("vec_id", "ascending")])  # so that of equal products the first have the smallest ids
        own = number(asks, "row")
        i, j, score, _ = best_of_block(_matrix(whole(asks, "vec"), "f8"), number(asks, "least").astype(float), own, _matrix(whole(block, "vec"), "f8"), _matrix(whole(block, "code"), "u1"), number(block, "scale"), number(block, "error"), number(block, "row"), c[number(asks, "cell")[0]], turn, k)
        return pa.table([pa.array(own[i]), whole(block, "vec_id").take(pa.array(j)), pa.array(score)], names)

    found = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"row long, vec_id {kind}, score double"))
    discard(plan)
    return found


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, dims: int | None = None, asks: Column | None = None, errors: float = ERRORS, cell_rows: int = CELL_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, nearest first.

    Queries are the rows with ``asks`` (a condition on vec_id), or those whose id, or its hash if it is no number, is divisible by ``every``.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    if dims is None:
        common = rows.filter("size(e) > 0").groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = common["n"] if common else 1
    number = F.col("vec_id") if isinstance(rows.schema["vec_id"].dataType, NumericType) else F.xxhash64("vec_id")
    rows = rows.filter(f"size(e) = {int(dims)} AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(e, x -> x <> 0)")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(asks if asks is not None else number % every == 0, F.lit(False)).alias("asks"), "e"))
    c, turn = cells(rows, dims, min(MAX_CELLS, -(-rows.count() // cell_rows) or 1)), rotation(dims)
    index = cut(_indexed(rows, c, turn, errors))
    discard(rows)
    radius = np.full(len(c), -1.0)  # no vector there
    for r in index.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radius[r["cell"]] = r["far"]
    queries = index.filter("asks").select("row", F.col("vec_id").alias("query_id"), "vec", F.lit(None).cast("double").alias("least"), F.lit(None).cast("int").alias("home"))
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    homes = cut(_routed(queries, c, radius, True))
    near = _scanned(homes, index, c, turn, k)
    least = near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("row", F.col("score").alias("kth"))
    asked = cut(homes.join(least, "row", "left").select("row", "vec", F.col("kth").alias("least"), "home"))
    others = cut(_routed(asked, c, radius, False))
    more = _scanned(others, index, c, turn, k)
    ranked = near.unionByName(more).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("of"), "query_id")
    discard(homes, asked, others)
    return ranked.join(names, F.col("row") == F.col("of")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Centroid clustering with heap-ordered bounds, in exact integers.

Vectors become integers floor(``scale`` * x). Each vector of a cluster has a gap: the distance to its second nearest centroid less
that to its own. When centroids move, a gap shrinks by at most the move of its own centroid and the largest move of another one.
Instead of shrinking all gaps, each cluster adds these to a drift, and a vector enters its cluster's heap under its gap plus the drift
of that moment: the vectors whose gap may have expired are those that the heap gives up below the present drift. Only they are popped,
rescanned against all centroids with exact squared distances, and pushed again; a heap whose first key is beyond the drift isn't touched.

Spark holds the vectors in blocks of BLOCK, a row each, in integers as narrow as they allow, beside the heaps of all clusters as arrays
in heap order. A round maps the blocks and writes the next table; from it come the changes of sums and counts of clusters, those that
vectors took along when they changed cluster, added up within each task and then by cluster and component. The driver holds
``k`` centroids, never vectors.

Defined cases: vectors that are null, have another length, or hold a null or non-finite component are left out; ties go to the
smaller centroid number; with fewer than ``k`` vectors each is a first centroid; equal vectors may be first centroids twice, and the second then stays
empty and where it is; rows that repeat an id stay apart rows, and a null id counts as an empty one in the hash; an empty table gives an empty
result; other columns are not read. Components so large that a squared distance would not fit in a long are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stepweave.session import cut, discard

BLOCK = 4_096
_SLACK = 1e-9  # relative; distances are rounded to about 1e-16


def whole_vectors(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` finite components as arrays of longs."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.filter(f"size(e) = {int(dims)} AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    limit = int((2**63 - 1) // (4 * dims)) ** 0.5  # two components this large differ by twice as much
    fits = f"abs({int(scale)} * x) < {limit:.0f}D"
    return rows.select("vec_id", F.expr(f"transform(e, x -> if({fits}, floor({int(scale)} * x), cast(raise_error('a component is too large for whole distances') AS bigint)))").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id, in order; those of one id by their components."""
    h = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors by centroids)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**53:  # every step is a whole number that a double holds
        a, b = x.astype(float), c.astype(float)
        return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, smaller ones first, and the gap to the second nearest."""
    d = squares(x, c)
    own = d.argmin(1)
    near = d[np.arange(len(x)), own]
    if c.shape[0] == 1:
        return own, np.full(len(x), np.inf)
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(1).astype(float)) - np.sqrt(near.astype(float))


class Heaps:
    """One heap of (key, vector) for each cluster of a block."""

    def __init__(self, keys: np.ndarray, slots: np.ndarray, start: np.ndarray) -> None:
        self.keys, self.slots, self.start = keys, slots, start

    @classmethod
    def of(cls, own: np.ndarray, keys: np.ndarray, k: int) -> Heaps:
        order = np.lexsort((keys, own))  # ascending keys are a heap
        return cls(keys[order], order.astype(np.int32), np.searchsorted(own[order], np.arange(k + 1)).astype(np.int32))

    def clusters(self) -> np.ndarray:
        own = np.empty(len(self.slots), np.int64)
        own[self.slots] = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return own

    def rescan(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop what has expired, find its nearest centroids and push it again: (vectors, old clusters, new clusters)."""
        k, expired, old, heaps = len(drift), [], [], {}
        bound = drift + _SLACK * (1 + drift + np.abs(c).max(initial=1) * c.shape[1])
        as_heap = lambda j: list(zip(self.keys[self.start[j] : self.start[j + 1]].tolist(), self.slots[self.start[j] : self.start[j + 1]].tolist()))
        first = np.full(k, np.inf)
        some = np.flatnonzero(np.diff(self.start))
        first[some] = self.keys[self.start[some]]
        for j in np.flatnonzero(first <= bound).tolist():
            heap = heaps[j] = as_heap(j)
            while heap and heap[0][0] <= bound[j]:
                expired.append(heappop(heap)[1])
                old.append(j)
        at, old = np.array(expired, np.int64), np.array(old, np.int64)
        if not len(at):
            return at, old, old
        new, gap = nearest(x[at], c)
        for v, j, key in zip(expired, new.tolist(), (gap + drift[new]).tolist()):
            if j not in heaps:
                heaps[j] = as_heap(j)
            heappush(heaps[j], (key, v))
        sizes = np.diff(self.start)
        parts = [heaps[j] if j in heaps else None for j in range(k)]
        sizes = np.array([len(p) if p is not None else sizes[j] for j, p in enumerate(parts)])
        lo = self.start
        self.keys, self.slots = (
            np.concatenate([self.keys[lo[j] : lo[j + 1]] if p is None else np.array([e[0] for e in p], float) for j, p in enumerate(parts)]),
            np.concatenate([self.slots[lo[j] : lo[j + 1]] if p is None else np.array([e[1] for e in p], np.int32) for j, p in enumerate(parts)]),
        )
        self.start = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return at, old, new


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dims)}").reshape(n, dims).astype(np.int64)


_STATE = "data binary, keys binary, slots binary, start binary, rescanned long, change array<struct<cluster int, n long, sum array<long>>>"
_NAMES = ["ids", "data", "keys", "slots", "start", "rescanned", "change"]
_CHANGE = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sum", pa.list_(pa.int64()))]))


def _row(ids: pa.Array | None, kind: pa.DataType, data: bytes | None, heaps: Heaps | None, seen: int, change: list[dict] | None) -> pa.RecordBatch:
    packed = [h.tobytes() for h in (heaps.keys, heaps.slots, heaps.start)] if heaps else [None] * 3
    listed = pa.nulls(1, pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, pa.array([data], pa.binary()), *(pa.array([p], pa.binary()) for p in packed), pa.array([seen], pa.int64()), pa.array([change], _CHANGE)], _NAMES)


def _changes(sums: np.ndarray, counts: np.ndarray) -> list[dict]:
    return [{"cluster": j, "n": int(counts[j]), "sum": sums[j].tolist()} for j in np.flatnonzero(counts.astype(bool) | sums.any(1)).tolist()]


def _moved(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, to: np.ndarray, sign: int) -> None:
    np.add.at(sums, to, sign * x)
    np.add.at(counts, to, sign)


def _first_round(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """Blocks of all vectors with their heaps; the last row of a task holds sums and counts alone."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, id_type, held = np.zeros_like(c), np.zeros(len(c), np.int64), pa.int64(), []

        def block(part: pa.Table) -> pa.RecordBatch:
            ids = part.column(0).combine_chunks()
            x = part.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            own, gap = nearest(x, c)
            _moved(sums, counts, x, own, 1)
            return _row(ids, ids.type, _narrow(x).tobytes(), Heaps.of(own, gap, len(c)), len(x), None)

        for batch in batches:
            id_type = batch.schema.field(0).type
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                whole = pa.Table.from_batches(held)
                full = whole.num_rows // BLOCK * BLOCK
                for lo in range(0, full, BLOCK):
                    yield block(whole.slice(lo, BLOCK))
                held = whole.slice(full).to_batches()
        if held and sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))
        if counts.any():
            yield _row(None, id_type, None, None, 0, _changes(sums, counts))

    return rows.select("vec_id", "v").mapInArrow(run, f"ids array<{kind}>, {_STATE}")


def _next_round(state: DataFrame, c: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after new centroids; the last row of a task holds the changes of sums and counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, id_type = np.zeros_like(c), np.zeros(len(c), np.int64), pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                data, keys, slots, start = (batch.column(k)[i].as_py() for k in range(1, 5))
                heaps = Heaps(np.frombuffer(keys, float), np.frombuffer(slots, np.int32), np.frombuffer(start, np.int32))
                x = _matrix(data, len(heaps.slots), c.shape[1])
                at, old, new = heaps.rescan(x, c, drift)
                went = old != new
                _moved(sums, counts, x[at[went]], old[went], -1)
                _moved(sums, counts, x[at[went]], new[went], 1)
                ids = batch.column(0).slice(i, 1).flatten()
                yield _row(ids, id_type, data, heaps, len(at), None)
        if counts.any() or sums.any():
            yield _row(None, id_type, None, None, 0, _changes(sums, counts))

    return state.filter("data IS NOT NULL").select(*_NAMES).mapInArrow(run, state.schema.simpleString()[7:-1])


def _added(state: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Sums and counts after the changes that ``state`` holds; k * dims numbers come to the driver."""
    changes = state.filter("change IS NOT NULL").select(F.explode("change").alias("x")).select("x.*")
    for r in changes.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        counts[r["cluster"]] += r["n"]
    for r in changes.select("cluster", F.posexplode("sum").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("s").alias("s")).collect():
        sums[r["cluster"], r["d"]] += r["s"]


def _assigned(state: DataFrame, c: np.ndarray, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, keys, slots, start = (batch.column(k)[i].as_py() for k in range(1, 5))
                own = Heaps(np.frombuffer(keys, float), np.frombuffer(slots, np.int32), np.frombuffer(start, np.int32)).clusters()
                x = _matrix(data, len(own), c.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(own.astype(np.int32)), pa.array(((x - c[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return state.filter("data IS NOT NULL").select(*_NAMES[:5]).mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """((vec_id, cluster, distance) of each kept vector, written; the final centroids; how many vectors each round scanned)."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    c = first_centroids(rows, k, seed)
    if not len(c):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), c, []
    sums, counts, drift, scanned = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c)), []
    state = cut(_first_round(rows, c))
    for _ in range(rounds):
        _added(state, sums, counts)
        before, full = c, counts > 0
        c = c.copy()
        c[full] = sums[full] // counts[full][:, None]
        moved = np.sqrt(((c - before) ** 2).sum(1).astype(float))
        if len(c) > 1:
            top = np.sort(moved)[-2:]
            drift = drift + moved + np.where(moved == top[1], top[0], top[1])  # own move, and the largest of another
        scanned.append(state)
        after = cut(_next_round(state, c, drift))
        scanned[-1] = state.agg(F.sum("rescanned")).first()[0]
        discard(state)
        state = after
    scanned.append(state.agg(F.sum("rescanned")).first()[0])
    out = cut(_assigned(state, c, kind))
    discard(state)
    return out, c, scanned


def clusters(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector."""
    found, c, _ = clustered(vectors, **how)
    by = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    facts = [(j, s, sum(by.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, s in by.items()]
    table = found.sparkSession.createDataFrame(facts, "j int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), F.col("cluster") == F.col("j")).drop("j")

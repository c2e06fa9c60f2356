"""Exact searches among unit vectors, and among colours, that pass over what can't be in the result.

Vectors: each belongs to the nearest of a few cells, whose centroids come from at most SAMPLE rows (the documented bound; it decides on speed
alone). A cell's radius is the largest distance of a vector from its centroid, so no product of a unit query with a vector of the cell exceeds
the query's product with the centroid plus the radius. Queries first visit the cell that promises most, then, with the kth product found
there, those cells alone that may still reach it. A visit is a task of at most BLOCK_ROWS vectors and QUERY_ROWS queries: one
matrix product in single precision leaves what is near the kth or the least product, which is computed again component by
component. There are as many cells as rows ask for, and as many tasks as blocks, so work is spread at any size.

Colours: the palette lies in cells of the RGB cube. A colour asks the rings of cells around its own, the nearest first, until the kth
distance is below what the next ring can offer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.functions import scalars as s
from stepweave.session import cut, discard

SAMPLE, CELL_ROWS, MAX_CELLS = 10_000, 4_096, 256
BLOCK_ROWS, QUERY_ROWS, MAX_TASKS = 8_192, 1_024, 4_096
_SLACK = 1e-5  # of products of unit vectors in single precision


def unit_rows(rows: DataFrame, key: str, label: str | None, embedding: str = "embedding") -> DataFrame:
    """(id, label, v): unit vectors; rows without a direction are dropped."""
    return rows.select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), s.l2_normalize(F.col(embedding)).alias("v")).filter("v IS NOT NULL")


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), float).reshape(len(col), -1)


def centroids(rows: DataFrame, cell_rows: int) -> np.ndarray:
    """Cell centroids by a few rounds of k-means over a bounded sample."""
    n = rows.count()
    h = F.xxhash64("id")
    some = rows if n <= SAMPLE else rows.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 0.95 * SAMPLE / n))
    x = np.array([r["v"] for r in some.select("v").limit(SAMPLE).collect()], float)
    if not len(x):
        return np.zeros((1, 1))
    c = x[np.random.default_rng(7).permutation(len(x))[: min(MAX_CELLS, -(-n // cell_rows))]]
    for _ in range(8):
        own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        size, total = np.bincount(own, minlength=len(c)), np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def cell_index(rows: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(written (id, label, vec, cell, far), centroids) of unit rows; vectors of another length than most are left out."""
    rows = cut(rows)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole, rows = rows, rows.filter(F.size("v") == (common["n"] if common else 1))
    c = centroids(rows, cell_rows)
    kinds = [rows.schema[k].dataType.simpleString() for k in ("id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                far = np.sqrt(((x - c[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _blob(x), pa.array(own.astype(np.int32)), pa.array(far)], ["id", "label", "vec", "cell", "far"])

    index = cut(rows.select("id", "label", "v").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, vec binary, cell int, far double"))
    discard(whole)
    return index, c


def _every(index: DataFrame) -> Column:
    """All cells that hold a vector, at most MAX_CELLS, with their radii, as a constant."""
    rows = index.groupBy("cell").agg(F.max("far").alias("far")).collect()
    return F.from_json(F.lit(json.dumps([{"cell": r["cell"], "far": r["far"]} for r in rows])), "array<struct<cell:int,far:double>>")


def _asked(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(id, label, any, vec, least, home, cells): unit rows with the cells that they may visit; ``any`` where the label names no vector."""
    cells = index.groupBy("label", "cell").agg(F.max("far").alias("far"))
    by_label = cells.filter("label IS NOT NULL").groupBy(F.col("label").alias("known")).agg(F.collect_list(F.struct("cell", "far")).alias("own"))  # at most MAX_CELLS each
    met = rows.join(by_label, F.col("label") == F.col("known"), "left").withColumn("every", _every(index))
    return met.select("id", "label", F.col("own").isNull().alias("any"), "v", F.lit(None).cast("double").alias("least"), F.lit(None).cast("int").alias("home"), F.coalesce("own", "every").alias("cells"))


def _routed(asked: DataFrame, c: np.ndarray, first: bool) -> DataFrame:
    """``asked`` with a cell to visit a row: the most promising one, or all others that may reach ``least`` (all, where it is unknown)."""
    names = ["id", "label", "any", "vec", "least", "home", "cell"]
    kinds = [asked.schema[k].dataType.simpleString() for k in ("id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = batch.column(6)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False))
            entry = cells.flatten()
            cell, far = entry.field(0).to_numpy(zero_copy_only=False), entry.field(1).to_numpy(zero_copy_only=False)
            reach = (q @ c.T)[row, cell] + far + 1e-9
            if first:
                order = np.lexsort((cell, -reach, row))
                go = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
                home = cell[go]
            else:
                least = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
                home = batch.column(5).to_numpy(zero_copy_only=False)
                go = np.flatnonzero(~(reach < least[row]) & (cell != home[row]))
                home = home[row[go]]
            for lo in range(0, len(go), 4_096):
                part = slice(lo, lo + 4_096)
                at = pa.array(row[go[part]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), _blob(q[row[go[part]]]), batch.column(4).take(at), pa.array(home[part].astype(np.int32)), pa.array(cell[go[part]].astype(np.int32))], names)

    return asked.select("id", "label", "any", "v", "least", "home", "cells").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, any boolean, vec binary, least double, home int, cell int")


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of ``q`` and j of ``x``, added up component by component."""
    out = np.zeros(len(i))
    for d in range(q.shape[1]):
        out += q[i, d] * x[j, d]
    return out


def _visits(routed: DataFrame, index: DataFrame, compare: Callable[[pa.Table, pa.Table], tuple[list, int]], kinds: str, names: list[str]) -> DataFrame:
    """Written results of ``compare`` for each block of queries and of vectors that meet, and a row with ``compared`` alone for each."""
    size = lambda most: F.ceil(F.count("*") / most).cast("int")
    plan = cut(index.groupBy("cell").agg(size(BLOCK_ROWS).alias("parts")).join(routed.groupBy("cell").agg(size(QUERY_ROWS).alias("turns")), "cell"))
    n = min(int(plan.agg(F.sum(F.col("parts") * F.col("turns"))).first()[0] or 1), MAX_TASKS)
    keys = ["cell", "part", "turn"]
    deal = lambda rows, own, most, other, all_: rows.join(F.broadcast(plan), "cell").withColumn(own, F.expr(f"cast(pmod(xxhash64(id), {most}) AS int)")).withColumn(other, F.explode(F.expr(f"sequence(0, {all_} - 1)"))).drop("parts", "turns").repartition(n, *keys)
    left, right = deal(routed, "turn", "turns", "part", "parts"), deal(index, "part", "parts", "turn", "turns")

    def meet(asks: pa.Table, block: pa.Table) -> pa.Table:
        arrays, compared = compare(asks, block) if asks.num_rows and block.num_rows else ([], 0)
        rows = pa.table([*arrays, pa.nulls(len(arrays[0]), pa.int64())], [*names, "compared"]) if arrays else None
        if rows is None:
            return pa.table([pa.nulls(1, asks.schema.field("id").type), *(pa.nulls(1, t) for t in types(block)), pa.array([compared])], [*names, "compared"])
        tail = pa.table([*(pa.nulls(1, c.type) for c in rows.columns[:-1]), pa.array([compared])], rows.column_names)
        return pa.concat_tables([rows, tail])

    types = lambda block: [block.schema.field("id" if names[1] == "candidate" else "label").type, pa.float64()]
    found = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"{kinds}, compared long"))
    discard(plan)
    return found


def _same(asks: pa.Table, block: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides that may be compared: equal labels, or all for queries that take any."""
    any_ = asks.column("any").to_numpy()
    wanted, held = asks.column("label").combine_chunks(), block.column("label").combine_chunks()
    known = pc.unique(wanted).drop_null()
    a, b = (pc.index_in(x, known).fill_null(-1).to_numpy(zero_copy_only=False) for x in (wanted, held))
    out = [(np.flatnonzero(any_), np.arange(block.num_rows))] if any_.any() else []
    a = np.where(any_, -2, a)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], np.arange(len(known))), np.searchsorted(b[order], np.arange(len(known)), "right")
    return out + [(np.flatnonzero(a == k), order[lo[k] : hi[k]]) for k in np.unique(a[a >= 0]).tolist() if hi[k] > lo[k]]


def nearest_unit(queries: DataFrame, catalog: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """((query, rank, candidate, score), one row with the number of ``compared`` pairs): the ``k`` largest products of unit rows.

    Candidates are the catalog's rows with the query's label, or all where the catalog lacks it, but the query's own id; ties go to
    the smaller candidate. Fewer than ``k`` candidates are all found.
    """
    index, c = cell_index(catalog, cell_rows)
    kinds = f"query {queries.schema['id'].dataType.simpleString()}, candidate {index.schema['id'].dataType.simpleString()}, score double"

    def compare(asks: pa.Table, block: pa.Table) -> tuple[list, int]:
        block = block.sort_by([("id", "ascending")])
        q, x = _matrix(asks.column("vec")), _matrix(block.column("vec"))
        ids, own = block.column("id").to_numpy(), asks.column("id").to_numpy()
        least = asks.column("least").to_numpy().astype(float)
        q32, x32, left, right, compared = q.astype(np.float32), x.astype(np.float32), [], [], 0
        for some, at in _same(asks, block):
            for lo in range(0, len(some), 128):
                part = some[lo : lo + 128]
                score = q32[part] @ x32[at].T
                compared += score.size
                score[own[part][:, None] == ids[at][None, :]] = -np.inf
                floor = np.where(np.isnan(least[part]), -np.inf, least[part])
                if len(at) > k:
                    floor = np.maximum(floor, np.partition(score, len(at) - k, axis=1)[:, len(at) - k])
                i, j = np.nonzero((score >= (floor - 2 * _SLACK)[:, None]) & (score > -np.inf))
                left.append(part[i])
                right.append(at[j])
        if not left:
            return [], compared
        i, j = np.concatenate(left), np.concatenate(right)
        score = products(q, x, i, j)
        by = np.lexsort((j, -score, i))
        i, j, score = i[by], j[by], score[by]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        good = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
        return [asks.column("id").combine_chunks().take(pa.array(i[good])), block.column("id").combine_chunks().take(pa.array(j[good])), pa.array(score[good])], compared

    asked = cut(_asked(queries.filter(F.size("v") == c.shape[1]), index))
    homes = cut(_routed(asked, c, True))
    names = ["query", "candidate", "score"]
    near = _visits(homes, index, compare, kinds, names)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))
    kth = near.filter("query IS NOT NULL").withColumn("rank", place).filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("kth"))
    at_home = homes.select("id", F.col("home").alias("at"))
    again = cut(asked.join(at_home, "id").join(kth, "id", "left").select("id", "label", "any", "v", F.col("kth").alias("least"), F.col("at").alias("home"), "cells"))
    others = cut(_routed(again, c, False))
    found = near.unionByName(_visits(others, index, compare, kinds, names))
    discard(asked, homes, again, others, index)
    best = found.filter("query IS NOT NULL").withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("query", "rank", "candidate", "score"), found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def best_by_label(queries: DataFrame, memory: DataFrame, least: float, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """((query, label, score), one row with the number of ``compared`` pairs): largest product of each query and label, from ``least`` up.

    Within a block the products over the first half of the components, those with the largest spread, and the lengths of the rest bound each
    pair; only pairs that may reach ``least`` are computed whole.
    """
    index, c = cell_index(memory, cell_rows)
    kinds = f"query {queries.schema['id'].dataType.simpleString()}, label {index.schema['label'].dataType.simpleString()}, score double"

    def compare(asks: pa.Table, block: pa.Table) -> tuple[list, int]:
        q, x = _matrix(asks.column("vec")), _matrix(block.column("vec"))
        order = np.argsort(-x.var(0))
        head, tail = order[: -(-len(order) // 2)], order[-(-len(order) // 2) :]
        rest = lambda m: np.sqrt((m[:, tail] ** 2).sum(1)).astype(np.float32)
        q32, x32, rx, left, right, compared = q[:, head].astype(np.float32), x[:, head].astype(np.float32), rest(x), [], [], 0
        for lo in range(0, len(q), 128):
            bound = q32[lo : lo + 128] @ x32.T + rest(q[lo : lo + 128])[:, None] * rx[None, :]
            i, j = np.nonzero(bound >= least - 2 * _SLACK)
            left.append(i + lo)
            right.append(j)
            compared += len(i)
        i, j = np.concatenate(left), np.concatenate(right)
        score = np.concatenate([products(q, x, i[lo : lo + 500_000], j[lo : lo + 500_000]) for lo in range(0, max(len(i), 1), 500_000)])
        good = score >= least
        i, j, score = i[good], j[good], score[good]
        labels = block.column("label").combine_chunks().dictionary_encode()
        code = labels.indices.fill_null(len(labels.dictionary)).to_numpy(zero_copy_only=False)[j]
        by = np.lexsort((-score, code, i))
        i, j, code, score = i[by], j[by], code[by], score[by]
        new = np.append(True, (i[1:] != i[:-1]) | (code[1:] != code[:-1])) if len(i) else np.zeros(0, bool)
        return [asks.column("id").combine_chunks().take(pa.array(i[new])), block.column("label").combine_chunks().take(pa.array(j[new])), pa.array(score[new])], compared

    asked = queries.filter(F.size("v") == c.shape[1]).select("id", "label", F.lit(True).alias("any"), "v", F.lit(float(least)).alias("least"), F.lit(-1).alias("home"), _every(index).alias("cells"))
    routed = cut(_routed(asked, c, False))
    found = _visits(routed, index, compare, kinds, ["query", "label", "score"])
    discard(routed, index)
    best = found.filter("query IS NOT NULL").groupBy("query", "label").agg(F.max("score").alias("score"))
    return best, found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def nearest_palette(wanted: DataFrame, palette: DataFrame, k: int, per_cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((r, g, b, rank, color_id, distance), one row with the number of ``compared`` pairs) of distinct asked colours (r, g, b).

    ``palette``: distinct colours (color_id, c). Cells have a side that leaves about ``per_cell`` colours each, were they spread evenly, a third of
    ``k`` if not given: then the kth is mostly nearer than a side. Each asked colour visits its own cell and those around it, then
    one ring more at a time, and is done once its kth distance is below the distance of what lies outside.
    """
    n = palette.count()
    side = int(min(256, max(8, round(256 * ((per_cell or max(k / 3, 1)) / max(n, 1)) ** (1 / 3)))))
    spot = lambda c: F.expr(f"cast({c} div {side} AS int)")
    held = cut(palette.select("color_id", *(F.col("c")[i].alias(f"p{i}") for i in range(3))).select("color_id", "p0", "p1", "p2", *(spot(f"p{i}").alias(f"c{i}") for i in range(3))))
    open_ = wanted.select("r", "g", "b", F.lit(None).cast("double").alias("kth"), F.array().cast("array<struct<distance:double,color_id:bigint>>").alias("best"))
    found, compared, cells = [], 0, -(-256 // side)
    own = lambda c: f"least(greatest({c} div {side}, 0), {cells - 1})"
    for ring in range(1, max(cells, 2)):
        axes = [F.explode(F.expr(f"sequence(greatest(0, {own(c)} - {ring}), least({cells - 1}, {own(c)} + {ring}))")).alias(f"c{i}") for i, c in enumerate("rgb")]
        asks = open_.select("r", "g", "b")
        for axis in axes:
            asks = asks.select("*", axis)
        asks = asks.filter(f"greatest(abs(c0 - {own('r')}), abs(c1 - {own('g')}), abs(c2 - {own('b')})) {'<=' if ring == 1 else '='} {ring}")
        met = asks.withColumns({f"c{i}": F.col(f"c{i}").cast("int") for i in range(3)}).join(held, ["c0", "c1", "c2"])
        scored = met.select("r", "g", "b", F.struct(F.sqrt(((F.col("r") - F.col("p0")) * (F.col("r") - F.col("p0")) + (F.col("g") - F.col("p1")) * (F.col("g") - F.col("p1")) + (F.col("b") - F.col("p2")) * (F.col("b") - F.col("p2"))).cast("double")).alias("distance"), F.col("color_id").cast("long").alias("color_id")).alias("hit"))
        near = scored.withColumn("nth", F.row_number().over(Window.partitionBy("r", "g", "b").orderBy("hit"))).withColumn("seen", F.count("*").over(Window.partitionBy("r", "g", "b"))).filter(F.col("nth") <= k)
        near = near.groupBy("r", "g", "b").agg(F.collect_list("hit").alias("fresh"), F.max("seen").alias("seen"))
        merged = open_.join(near, ["r", "g", "b"], "left").withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("fresh", F.array().cast("array<struct<distance:double,color_id:bigint>>")))), 1, k))
        # the nearest colour outside the rings seen so far is beyond their edge, one more than the distance to its last value
        edge = ", ".join(f"if({own(c)} + {ring} >= {cells - 1}, 1000, ({own(c)} + {ring + 1}) * {side} - {c}), if({own(c)} - {ring} <= 0, 1000, {c} - ({own(c)} - {ring}) * {side} + 1)" for c in "rgb")
        merged = cut(merged.withColumn("kth", F.expr(f"if(size(best) = {k}, best[{k - 1}].distance, NULL)")).withColumn("done", F.expr(f"coalesce(kth < least({edge}), false) OR {ring} >= {cells - 1}")))
        facts = merged.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.count_if(~F.col("done")).alias("left")).first()
        compared += facts["seen"]
        found.append(merged.filter("done").select("r", "g", "b", "best"))
        open_ = merged.filter("NOT done").select("r", "g", "b", "kth", "best")
        if not facts["left"]:
            break
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    listed = rows.select("r", "g", "b", F.posexplode("best").alias("nth", "hit")).select("r", "g", "b", (F.col("nth") + 1).alias("rank"), "hit.color_id", "hit.distance")
    return listed, wanted.sparkSession.createDataFrame([(compared,)], "compared long")

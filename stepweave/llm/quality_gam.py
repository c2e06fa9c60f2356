"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over the text's bytes and words (no label, language, source or id). Each is cut into quantile bins.
Boosting goes round the features again and again: each step fits a shallow tree on one feature's bins to the current
gradient and adds it, shrunk, to that feature's lookup table; then the pairs with the largest gain get two-dimensional
tables the same way. A score is a sum of table look-ups, done for a whole batch at once.

The model is fitted on at most MAX_LABELLED labelled rows (the smallest by hash of the id); every row is scored.

Defined cases: null and empty texts are scored like any other (all features 0); labels that are null or whose document is
absent are not learned from; with labels of one class only, every score is that class's share; an empty table gives an
empty result; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stepweave.llm.names import number_of, numbered
from stepweave.llm.sampling import bounded_sample
from stepweave.llm.textbytes import column_bytes, slices, words
from stepweave.session import cut, discard

MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 6, 60, 30, 0.15, 4
FEATURES = ("log_bytes", "log_words", "upper", "digit", "space", "newline", "symbol", "pipe", "bang", "stop", "comma", "high_byte", "mean_word", "repeat_next", "distinct", "top_share", "symbol_end", "upper_words")

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"#$%&*+=<>@^_~\\{}[]", b"|", b"!", b".?", b",;:"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10


def features(col: pa.Array) -> np.ndarray:
    """(rows, features) of a string column; ratios are to bytes or words."""
    raw, off = column_bytes(col)
    return np.concatenate([_features(raw, off[i : j + 1]) for i, j in slices(off)] or [np.zeros((0, len(FEATURES)))])


def _features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n, lo = len(off) - 1, int(off[0])
    b, size = raw[lo : int(off[-1])], np.diff(off).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(off))
    kinds = _CLASS[b]
    count = np.bincount(row_of * 11 + kinds, minlength=11 * n).reshape(n, 11).astype(float)
    row, h = words(raw, off)
    total = np.bincount(row, minlength=n).astype(float)
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n).astype(float)
    order = np.lexsort((h, row))
    r, s = row[order], h[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[first], minlength=n).astype(float)
    runs = np.diff(np.append(np.flatnonzero(first), len(s)))
    top = np.zeros(n)
    np.maximum.at(top, r[first], runs)
    # words that end in a symbol: a symbol byte before white space or the end; words that begin with two capitals
    ends = np.zeros(len(b), bool)
    starts2 = np.zeros(len(b), bool)
    if len(b):
        after = np.append(kinds[1:], 3)
        after[off[1:-1][(off[1:-1] > lo) & (off[1:-1] - lo < len(b))] - lo - 1] = 3
        ends = np.isin(kinds, (5, 7)) & np.isin(after, (3, 4))
        before = np.insert(kinds[:-1], 0, 3)
        starts2 = (kinds == 1) & (after == 1) & np.isin(before, (3, 4))
    per = lambda flag: np.bincount(row_of[flag], minlength=n).astype(float)
    by, bw = np.maximum(size, 1), np.maximum(total, 1)
    return np.column_stack([np.log1p(size), np.log1p(total), *(count[:, k] / by for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)), (size - count[:, 3] - count[:, 4]) / bw, same / bw, distinct / bw, top / bw, per(ends) / bw, per(starts2) / bw])


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; small and of a fixed size, so it travels with the tasks."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Newton values of the bins of one feature, cut greedily into at most ``leaves`` runs of bins."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    cuts = [0, len(grad)]
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + worth(mid, b) - worth(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(mid[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the single tables, then of the strongest pairs."""
    k = x.shape[1]
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    edges, pair_edges = [_edges(x[:, j], BINS) if len(y) else np.zeros(0) for j in range(k)], [_edges(x[:, j], PAIR_BINS) if len(y) else np.zeros(0) for j in range(k)]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [], [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-f))
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), LEAVES)
            model.tables[j] += step
            f += step[bins[j]]
    p = 1 / (1 + np.exp(-f))

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        return coarse[i] * shape[1] + coarse[j], shape

    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            at, shape = cells(i, j)
            g, h = np.bincount(at, y - p, shape[0] * shape[1]), np.bincount(at, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g * g / (h + 1.0)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros(cells(i, j)[1]) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs):
            at, shape = cells(i, j)
            p = 1 / (1 + np.exp(-f))
            step = RATE * np.bincount(at, y - p, t.size) / (np.bincount(at, p * (1 - p), t.size) + 5.0)
            t += step.reshape(shape)
            f += step[at]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on at most ``max_labelled`` labelled rows; the sample, of known size, is broadcast to find its texts.

    Texts of ids that repeat are labelled rows too; the same bound holds for them before anything is gathered.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    sample = bounded_sample(known, ["_id", "_y"], max_labelled)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id").select("_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["_y", *FEATURES])

    known = cut(texts.mapInArrow(run, "_y double, " + ", ".join(f"{f} double" for f in FEATURES)))
    rows: pd.DataFrame = bounded_sample(known, ["_y", *FEATURES], max_labelled).toPandas()
    discard(known)
    rows = rows.sort_values(list(rows.columns))  # any order of arrival gives one model
    return fit(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float))


def scores(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), a row for each row of ``docs``."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model accepts, in one pass and with the same columns."""

    at = int(number_of(docs, text)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)

"""Order-dependent rules over sorted groups, without a pandas frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 10_000


def fold_groups(rows: DataFrame, key: str, order: list[str], rule: Callable[[Iterator[dict]], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """``rule`` applied to the rows of each key, a stream of dicts sorted by ``order``.

    One shuffle by key and a sort that can spill; rows stream through the rule, which holds what it looks back and ahead at: a
    few pages of a manual, or all boxes of one page.
    """
    out = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    kinds = to_arrow_schema(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        for _, group in groupby(stream(batches), key=lambda r: r[key]):
            for row in rule(group):
                done.append(row)
                if len(done) >= BATCH:
                    yield pa.RecordBatch.from_pylist(done, kinds)
                    done = []
        yield pa.RecordBatch.from_pylist(done, kinds)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)

"""Bounded samples for training.

Defined cases: rows that are equal in the keys have one hash and come or go together before the limit, which alone parts them;
null keys hash like values; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded_sample(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` of ``rows``, chosen by the hash of ``keys``; all of them if there are no more.

    The hash leaves about ``most`` rows before anything is gathered, so no task or driver gets ``most`` rows from every task.
    """
    n = rows.count()
    h = F.xxhash64(*keys)
    if n > most:
        rows = rows.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 0.95 * most / n))
    return rows.orderBy(h, *keys).limit(most)

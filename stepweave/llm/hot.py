"""Left joins with one row for each key, where a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stepweave.session import cut

HOT_ROWS, MAX_HOT = 1_000, 10_000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, least: int = HOT_ROWS, most: int = MAX_HOT) -> DataFrame:
    """``rows`` left joined with ``groups`` (``keys`` once each, ``size`` and other figures) on ``keys``.

    The largest groups, at most ``most`` and of at least ``least`` rows each, are broadcast; their rows take part in the
    shuffled join under salts that match nothing, so they are spread over all its tasks, and so are rows with a null key, which
    match nothing either. Any other group has fewer rows than ``least`` or a share below 1 / ``most``.
    """
    figures = [c for c in groups.columns if c not in keys]
    hot = cut(groups.filter(F.col(size) >= least).orderBy(F.desc(size), *keys).limit(most)).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.struct(*figures).alias("_hot"))
    met = rows.join(F.broadcast(hot), [rows[k] == hot[f"_hot_{k}"] for k in keys], "left")
    plain = F.col("_hot").isNull()
    for k in keys:
        plain = plain & F.col(k).isNotNull()
    met = met.withColumn("_salt", F.when(plain, F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id() % (1 << 16)))
    # the salt of a group is always 0, but not a literal, so it stays part of the join's key
    cold = groups.select(*(F.col(k).alias(f"_cold_{k}") for k in keys), F.least(F.col(size).cast("long"), F.lit(0)).alias("_zero"), F.struct(*figures).alias("_cold"))
    out = met.join(cold, [*(met[k] == cold[f"_cold_{k}"] for k in keys), met["_salt"] == cold["_zero"]], "left")
    return out.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_figures")).select(*rows.columns, "_figures.*")

"""State changes committed to a store of versioned tables, each with all tables it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stepweave.operators import state
from stepweave.sources.versioned import Conflict, Store

BUCKETS = 64


def truth_upsert(store: Store, batch: DataFrame) -> int:
    """Truth after ``batch`` and the conflicts so far, in one commit; the version.

    A batch that is committed again finds its own rows and changes nothing but repeats its conflicts once.
    """

    def change(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
        known = held.get("truth", batch.select(*state.KEY, "page").limit(0))
        outcome, after = state.truth_upsert(known, batch)
        conflicts = outcome.filter("status = 'conflict'").drop("status")
        if "conflicts" in held:
            conflicts = held["conflicts"].unionByName(conflicts).distinct()
        return {"truth": after, "conflicts": conflicts}

    return store.update(change, ["truth", "conflicts"], "truth upsert")


def replace_latest(store: Store, name: str, batch: DataFrame, keys: list[str], order: str, keep_missing: bool = False) -> int:
    """Table ``name`` after ``batch``, last write wins by ``order``; the version."""
    change = lambda held: {name: state.replace_latest(held.get(name, batch.limit(0)), batch, keys, order, keep_missing)}
    return store.update(change, [name], "replace by key")


def bundle_upsert(store: Store, registered: DataFrame) -> int:
    """The bundle index after ``registered`` (bundle_id, path); the version."""
    none = registered.select("bundle_id", "path", F.lit(None).cast("string").alias("status")).limit(0)
    return store.update(lambda held: {"bundles": state.bundle_upsert(held.get("bundles", none), registered)}, ["bundles"], "bundle upsert")


def merge_in_buckets(store: Store, name: str, batch: DataFrame, key: Column, fold: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, tries: int = 5) -> int:
    """``fold`` of stored and new rows, in the buckets of ``key`` that ``batch`` touches alone; the version.

    ``fold`` must give the same result whatever has been folded before, so a batch may come again.
    """
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return store.version()
    for left in range(tries - 1, -1, -1):
        at = store.version()
        merged = rows
        if name in store.tables(at):
            merged = rows.unionByName(store.read(name, at, touched).select(rows.columns))
        try:
            return store.write({name: fold(merged)}, parts={name: "bucket"}, read_at=at, reads=[name], note="merge")
        except Conflict:
            if not left:
                raise
    raise AssertionError

"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's rows are dealt into blocks of ``block_rows``. With integer weights a_s that sum to D, block j (from 1) of source s is
released at slot floor((j - 1) D / a_s) and due by ceil(j D / a_s); earliest-deadline-first fills one slot after another,
so after any number of slots each source is less than one block from its share. As the schedule repeats after D
slots, at most one period is laid out on the driver, whatever the number of blocks, and each block finds its slot by
arithmetic. When a source ends, the rest go on with their weights in a new phase; there are at most as many phases as
sources. Every row is kept, each once.

The driver holds one count and one weight for each source (at most MAX_SOURCES, else an error) and the laid out slots (at
most MAX_SLOTS over all phases, else an error; weights are divided by their greatest common divisor first), never rows. Ranks
within a source come from hash buckets of about a block each and prefix sums over bucket counts, so a hot source is
spread over as many tasks as it has blocks.

Defined cases: null is a source of its own; sources without a weight, and weights below 1, get the smallest, 1; weights of absent
sources are ignored; rows with equal or null ids stay apart rows, in any order among them, and where one id has more rows than a block all
rows are numbered first, so that they spread; an empty table gives an empty result; all columns are kept whatever their names.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, Window, functions as F

from stepweave.session import cut

MAX_SOURCES, MAX_SLOTS, PERIOD, BLOCK_ROWS = 1_000, 1_000_000, 1_000, 256


def first_slots(weights: dict, left: dict, most: int = MAX_SLOTS) -> tuple[dict, bool]:
    """Slots of each source by earliest deadline among the released blocks, until a period or one of ``left`` ends; whether one did."""
    d, released, waiting, slots = sum(weights.values()), [], [], {s: [] for s in weights}
    order = {s: i for i, s in enumerate(sorted(weights, key=lambda s: (-weights[s], s is None, str(s))))}
    for s in weights:
        heapq.heappush(waiting, (0, order[s], s, 1))
    for t in range(d):
        if t >= most:
            raise ValueError(f"the weights need more than {MAX_SLOTS} slots to lay out")
        while waiting and waiting[0][0] <= t:
            _, o, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-j * d // weights[s]), o, s, j))
        _, o, s, j = heapq.heappop(released)
        slots[s].append(t)
        if j == left[s]:
            return slots, True
        if j < weights[s]:
            heapq.heappush(waiting, (j * d // weights[s], o, s, j + 1))
    return slots, False


def plan(counts: dict, weights: dict, block_rows: int) -> list[dict]:
    """One entry for each phase and source: its first block of the phase, the block after its last one, and where its blocks lie."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n}
    used, slot0, row0, out, laid = dict.fromkeys(left, 0), 0, 0, [], 0
    while left:
        shared = reduce(gcd, (weights[s] for s in left))
        alive = {s: weights[s] // shared for s in left}
        slots, _ = first_slots(alive, left, MAX_SLOTS - laid)
        laid += sum(map(len, slots.values()))
        d = sum(alive.values())
        # a source that ends within the period has its last slot laid out; one that ends later is found by whole periods
        last = {s: (n - 1) // alive[s] * d + slots[s][(n - 1) % alive[s]] for s, n in left.items() if (n - 1) % alive[s] < len(slots[s])}
        ends = min(last, key=last.get)
        full, rest = divmod(last[ends] + 1, d)
        for s in list(left):
            done = full * alive[s] + sum(x < rest for x in slots[s])
            if done:
                out.append({"source": s, "phase_block": used[s], "next_block": used[s] + done, "slot0": slot0, "row0": row0, "period": d, "weight": alive[s], "slots": slots[s]})
            used[s] += done
            left[s] -= done
            if not left[s]:
                del left[s]
        slot0 += last[ends] + 1
        row0 += last[ends] * block_rows + (counts[ends] - 1) % block_rows + 1  # all blocks of a phase are full but the one that ends it
    return out


def natural_weights(counts: dict, power: float = 0.7, period: int = PERIOD) -> dict:
    """Integer weights proportional to count ** power, at least 1 each, that sum to about ``period``."""
    total = sum(n**power for n in counts.values())
    return {s: max(1, round(period * n**power / total)) for s, n in counts.items()}


def mixed(rows: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row struct of all columns, source, block, slot, position), a row for each of ``rows``; position is 0, 1, 2, ...

    ``weights``: integers by source; without them, counts to the power 0.7.
    """
    spark = rows.sparkSession
    hashed = F.xxhash64(F.col(key))
    packed = rows.select(F.struct("*").alias("row"), F.col(source).alias("source"), hashed.alias("h"), F.xxhash64(F.col(source), F.col(key)).alias("tie"))
    lean = rows.select(F.col(source).alias("source"), hashed.alias("h"))
    if not lean.groupBy("source", "h").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).isEmpty():
        # an id with more rows than a block would fill a bucket of its own, so rows are numbered, once and for all
        packed = cut(packed.drop("h", "tie").withColumn("number", F.monotonically_increasing_id())).select("row", "source", F.xxhash64("number").alias("h"), F.col("number").alias("tie"))
        lean = packed.select("source", "h")
    found = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["source"]: r["n"] for r in found}
    given = natural_weights(counts) if weights is None else {s: max(1, int(weights.get(s, 1))) for s in counts}
    kind = packed.schema["source"].dataType.simpleString()
    # at most MAX_SLOTS slots over all rows, so the broadcast has a known bound
    phases = spark.createDataFrame([tuple(p.values()) for p in plan(counts, given, block_rows)], f"source {kind}, phase_block long, next_block long, slot0 long, row0 long, period long, weight long, slots array<int>")
    # sources go by number, so that rows are dealt once: a null-safe join would deal them by other keys than the ranks
    sizes = F.broadcast(spark.createDataFrame([(k, s, -(-n // block_rows)) for k, (s, n) in enumerate(counts.items())], f"sid int, s {kind}, blocks long"))
    in_bucket = lambda df: df.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.expr("pmod(h, blocks)"))
    per = in_bucket(lean).groupBy("sid", "bucket").agg(F.count("*").alias("k")).withColumn("page", F.expr("bucket div 1024"))
    page = per.groupBy("sid", "page").agg(F.sum("k").alias("k"))
    before = lambda w, order: F.coalesce(F.sum("k").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = page.select("sid", "page", before(Window.partitionBy("sid"), "page").alias("ahead"))
    within = per.withColumn("inner", before(Window.partitionBy("sid", "page"), "bucket"))
    start = within.join(page, ["sid", "page"]).select("sid", "bucket", (F.col("inner") + F.col("ahead")).alias("start"))
    ranked = in_bucket(packed).withColumn("nth", F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("h", "tie")) - 1).join(start, ["sid", "bucket"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("nth")).withColumn("block", F.expr(f"rank div {int(block_rows)}"))
    phase = F.col("source").eqNullSafe(F.col("fs")) & (F.col("block") >= F.col("phase_block")) & (F.col("block") < F.col("next_block"))
    placed = ranked.join(F.broadcast(phases.withColumnRenamed("source", "fs")), phase).withColumn("b", F.expr("block - phase_block"))
    placed = placed.withColumn("s", F.expr("b div weight * period + slots[cast(b % weight as int)]"))
    return placed.select("row", "source", "block", F.expr("slot0 + s").alias("slot"), F.expr(f"row0 + s * {int(block_rows)} + rank % {int(block_rows)}").alias("position"))


def in_mixed_order(rows: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with their columns, dealt to partitions and sorted by position: files written from it hold the mixture in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = -(-max(rows.count(), 1) // n)
    placed = mixed(rows, source, key, weights, block_rows).select("row", "position")
    return placed.repartitionById(n, F.expr(f"cast(position div {share} as int)")).sortWithinPartitions("position").select("row.*")

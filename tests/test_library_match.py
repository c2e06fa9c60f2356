"""F12 in blocks against one expression over all pairs of a set."""

import random
import time

from pyspark.sql import Window, functions as F

from stepweave.functions import scalars as s
from stepweave.operators import repairs

KINDS = "set_num long, id long, grey array<double>, rgb array<int>"


def plain(crops, library, k=5):
    c = crops.select("set_num", F.col("id").alias("crop"), F.col("grey").alias("cg"), F.col("rgb").alias("cr"))
    rows = c.join(library.select("set_num", F.col("id").alias("item"), F.col("grey").alias("ig"), F.col("rgb").alias("ir")), "set_num")
    colour = F.coalesce(s.rgb_similarity(s.rgb_distance(F.col("cr"), F.col("ir"))), F.lit(0.0))
    mse = F.aggregate(F.zip_with("cg", "ig", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v) / F.size("cg") / (255.0 * 255.0)
    rows = rows.withColumn("score", s.hash_colour_score(s.hamming_similarity(s.avg_hash(F.col("cg")), s.avg_hash(F.col("ig"))), mse, colour))
    w = Window.partitionBy("set_num", "crop").orderBy(F.desc("score"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("set_num", "crop", "rank", "item", "score")


def listed(df):
    return sorted(map(repr, df.collect()))


def test_blocks_are_all_pairs(spark):
    rng = random.Random(12)
    grey = lambda n=64: [rng.choice((0.0, 17.25, 200.0, 255.0)) * rng.random() for _ in range(n)]
    kinds = [grey(), None, grey(63), [*grey(63), None], [*grey(63), float("nan")], grey(70)]
    row = lambda i: (rng.choice((1, 1, 1, 2, 3, None)), i, rng.choice((kinds[rng.randrange(6)], grey(), grey())), rng.choice((None, [rng.randrange(256) for _ in range(3)], [1, None, 3], [9, 9, 9])))
    library = [row(i) for i in range(90)]
    library += [(1, 200 + i, kinds[0], [9, 9, 9]) for i in range(15)]  # copies, whose ties go by id
    crops, items = spark.createDataFrame([row(i) for i in range(25)] + [(1, 300, kinds[0], [9, 9, 9]), (7, 301, grey(), None)], KINDS), spark.createDataFrame(library, KINDS)
    want = listed(plain(crops, items))
    assert listed(repairs.library_match(crops, items)) == want
    assert listed(repairs.library_match(crops, items, crop_rows=4, item_rows=7)) == want


def test_large_set_in_time(spark):
    grid = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("set_num"), "id", F.expr("transform(sequence(1, 64), k -> cast((id * 7919 + k * k * 31) % 256 as double))").alias("grey"), F.expr("array(cast(id % 256 as int), cast(id * 7 % 256 as int), 9)").alias("rgb"))
    began = time.perf_counter()
    got = repairs.library_match(grid(100), grid(20_000)).collect()
    assert len(got) == 500 and all(r["score"] > 0.999 and r["item"] % 256 == r["crop"] % 256 for r in got if r["rank"] == 1)
    assert time.perf_counter() - began < 60

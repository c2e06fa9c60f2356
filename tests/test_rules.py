"""Small golden rows for order-dependent rules and edge cases."""

from stepweave.functions import scalars as f
from stepweave.operators import boxes, sequences, state
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_min_spacing_replaces_in_place(spark):
    starts = spark.createDataFrame([(1, 10, 12, 11, 0.5), (1, 13, 30, 29, 0.9), (1, 17, 14, 13, 0.5), (1, 40, 11, 10, 0.4)], "set_id long, page int, previous int, drop int, confidence double")
    assert [r[1] for r in rows(sequences.min_spacing(starts))] == [13, 40]


def test_consecutive_accept(spark):
    got = sequences.consecutive_accept(spark.createDataFrame([(1, 5, 1), (1, 9, 3), (1, 12, 2), (1, 20, 3)], "set_id long, page int, bag int"))
    assert [(r["page"], r["accepted"]) for r in sorted(got.collect())] == [(5, True), (9, False), (12, True), (20, True)]


def test_reset_scan_skips_implausible_pages(spark):
    steps = spark.createDataFrame([(1, 1, 30), (1, 2, 900), (1, 3, 1)], "set_id long, page int, value int")
    assert [(r["page"], r["bag_start"], r["reason"]) for r in sorted(sequences.reset_scan(steps).collect())] == [(1, False, ""), (2, False, "implausible step"), (3, True, "reset")]


def test_nms_keeps_best(spark):
    got = boxes.nms_score(spark.createDataFrame([(1, 1, 10, 10, 20, 20, 0.5), (1, 2, 12, 11, 20, 20, 0.9), (1, 3, 200, 10, 20, 20, 0.1)], "page long, box int, x int, y int, w int, h int, score double"))
    assert sorted(r["box"] for r in got.collect()) == [2, 3]


def test_merge_nearby_is_transitive(spark):
    got = boxes.merge_nearby(spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 15, 0, 10, 10), (1, 3, 30, 0, 10, 10), (1, 4, 300, 0, 10, 10)], "page long, box int, x int, y int, w int, h int"))
    assert sorted((r["x"], r["w"]) for r in got.collect()) == [(0, 40), (300, 10)]


def test_label_fold_keeps_label_under_flags(spark):
    events = spark.createDataFrame([(1, 1, 1, "save", 7), (1, 1, 2, "ignored", None), (1, 2, 1, "unknown", None), (1, 2, 2, "save", 9)], "crop long, slot int, seq long, kind string, label long")
    assert rows(state.label_event_fold(events)) == [(1, 1, 7, False, True), (1, 2, 9, False, False)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "set_id long, page int, value int")
    assert sequences.step_roles(none).count() == 0 and sequences.missing_numbers(spark.createDataFrame([], "set_id long, bag int, page int")).count() == 0
    assert sequences.context_outliers(none).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(f.safe_int(F.lit("1.0")).alias("a"), f.safe_int(F.lit(" 7 ")).alias("b"), f.hex_rgb(F.lit("#0aff10")).alias("c"), f.hex_rgb(F.lit("nope"), "black").alias("d"), f.ocr_variants(F.lit(178)).alias("e"), f.l2_normalize(F.array(F.lit(0.0))).alias("g")).first()
    assert row["a"] is None and row["b"] == 7 and row["c"] == [10, 255, 16] and row["d"] == [0, 0, 0] and row["e"] == [128, 173, 778] and row["g"] is None


def test_context_outliers_use_trimmed_maxima(spark):
    steps = [(1, p, v) for p, v in ((1, 10), (2, 11), (3, 90), (4, 12), (5, 13), (6, 14))]
    got = sequences.context_outliers(spark.createDataFrame(steps, "set_id long, page int, value int"))
    assert rows(got) == [(1, 3, 90)]


def test_gap_promotion_uses_a_box_once(spark):
    steps = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 9, 2)], "set_id long, page int, value int, box int")
    audit = spark.createDataFrame([(1, 1, 6, 7, 0.4), (1, 1, 6, 8, 0.9), (1, 1, 7, 8, 0.9), (1, 1, 8, 1, 0.9)], "set_id long, page int, value int, box int, confidence double")
    assert rows(sequences.gap_promotion(steps, audit)) == [(1, 1, 6, 8, 2)]

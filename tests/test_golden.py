"""Golden rows, worked out by hand, of rules that SQL doesn't express; and plain loops beside vectorised ones."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.functions import scalars
from stepweave.operators import acceptance, audits, boxes, catalog, images, repairs, sequences, state
from stepweave.plans import registry

BOX = "page long, box int, x int, y int, w int, h int"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_greedy_assign(spark):
    tokens = spark.createDataFrame([(1, 1, 0, 100, 10, 10), (1, 2, 100, 100, 10, 10)], BOX)
    parts = spark.createDataFrame([(1, 1, 90, 60, 20, 40), (1, 2, 200, 60, 20, 40), (1, 3, 0, 130, 10, 10)], BOX)
    # token 1 takes part 1 (95 off across, none down); token 2 then takes part 2; part 3 lies clearly below both
    assert rows(boxes.greedy_assign(tokens, parts), "token", "part", "score") == [(1, 1, 95.0), (2, 2, 105.0)]


def test_iou_dedupe(spark):
    given = spark.createDataFrame([(1, 1, 5, 0, 0, 20, 20, 0.5), (1, 2, 5, 8, 8, 20, 20, 0.9), (1, 3, 6, 100, 100, 20, 20, 0.4), (1, 4, 7, 102, 102, 20, 20, 0.3), (1, 5, 5, 300, 0, 20, 20, 0.1)], "page long, box int, step int, x int, y int, w int, h int, score double")
    assert rows(boxes.iou_dedupe(given), "box") == [(2,), (3,), (5,)]


def test_nms_text(spark):
    given = spark.createDataFrame([(1, 1, "2x", 0, 0, 20, 20, 0.5), (1, 2, "2x", 2, 2, 20, 20, 0.9), (1, 3, "3x", 2, 2, 20, 20, 0.1), (1, 4, "2x", 200, 0, 20, 20, 0.2)], "page long, box int, text string, x int, y int, w int, h int, score double")
    assert rows(boxes.nms_text(given), "box") == [(2,), (3,), (4,)]


def test_nms_score_prefers_the_visual_source(spark):
    given = spark.createDataFrame([(1, 1, 10, 10, 20, 20, 0.5, "read"), (1, 2, 12, 12, 20, 20, 0.5, "visual")], "page long, box int, x int, y int, w int, h int, score double, source string")
    assert rows(boxes.nms_score(given), "box") == [(2,)] and rows(boxes.nms_score(given.drop("source")), "box") == [(1,)]


def test_suspect_steps(spark):
    crops = [(1, 1, 5, None, None), (1, 2, 30, None, None), (1, 3, 7, None, None), (1, 4, 8, 3, None), (1, 5, 9, None, None), (1, 6, 12, None, [9, 12, 14]), (1, 7, 11, None, None)]
    got = repairs.suspect_steps(spark.createDataFrame(crops, "set_id long, page int, value int, id_step int, detected array<int>"))
    assert {(r["page"], r["value"]): sorted(r["reasons"]) for r in got.collect()} == {
        (2, 30): ["jump", "not below next page", "only one number fits"],
        (4, 8): ["id breaks order too"],
        (6, 12): ["not below next page", "only one number fits"],
    }
    one = spark.createDataFrame([(1, 1, 5, [5]), (1, 2, 9, [8]), (1, 3, 7, [7])], "set_id long, page int, value int, detected array<int>")
    assert "detected steps disagree" in {(r["page"]): r["reasons"] for r in repairs.suspect_steps(one).collect()}[2]
    assert rows(repairs.suspect_steps(spark.createDataFrame(crops, "set_id long, page int, value int, id_step int, detected array<int>").drop("id_step", "detected")), "page") == [(2,), (6,)]


def test_row_grouping(spark):
    given = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 50, 10, 10, 10), (1, 3, 0, 40, 10, 10), (1, 4, 90, 30, 10, 10)], BOX)
    # centres 5, 15, 35, 45: 15 joins 5 (mean 10), 35 starts a row, 45 joins it
    assert rows(boxes.row_grouping(given), "box", "row") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_fuzzy_rank(spark):
    given = spark.createDataFrame([(1, 9, 50.0, False), (1, 3, 47.0, False), (1, 5, 90.0, True), (1, 7, 80.0, False)], "set_id long, page int, score double, excluded boolean")
    assert [r["page"] for r in sorted(audits.fuzzy_rank(given).collect(), key=lambda r: r["rank"])] == [7, 3, 9, 5]


def test_audit_sample(spark):
    given = spark.range(100).select("id", (F.col("id") / 100).alias("score"))
    got = audits.audit_sample(given, "id", "score", n=10).collect()
    by = {b: sorted(r["id"] for r in got if r["bucket"] == b) for b in ("high", "low", "random")}
    assert by["high"] == list(range(90, 100)) and by["low"] == list(range(10)) and len(set(by["random"]) - set(by["high"]) - set(by["low"])) == 10


def test_library_match(spark):
    grey, other = [0.0] * 32 + [200.0] * 32, [200.0] * 32 + [0.0] * 32
    kinds = "set_num long, id long, grey array<double>, rgb array<int>"
    crops = spark.createDataFrame([(1, 1, grey, [10, 10, 10])], kinds)
    library = spark.createDataFrame([(1, 1, other, [10, 10, 10]), (1, 2, grey, [10, 10, 10]), (1, 3, None, [250, 10, 10]), (2, 4, grey, [10, 10, 10])], kinds)
    got = sorted(repairs.library_match(crops, library).collect(), key=lambda r: r["rank"])
    # same image and colour 1; opposite image: no hash bit, mse (200/255)^2; no image: colour alone
    mse = (200 / 255) ** 2
    want = [(2, 1.0), (1, 0.55 * 0.38 * (1 - mse) + 0.45), (3, 1 - 240 / 441.6729)]
    assert [r["item"] for r in got] == [i for i, _ in sorted(want, key=lambda w: -w[1])]
    assert all(abs(r["score"] - dict(want)[r["item"]]) < 1e-3 for r in got)


def test_dominant_colour(spark):
    # pale blue ground (B 230, G 220, R 190), near white, dark text and a red part
    px = [(230, 220, 190)] * 30 + [(250, 250, 250)] * 10 + [(20, 20, 20)] * 10 + [(30, 20, 200)] * 6
    df = spark.createDataFrame([(1, 7, 8, 3, bytearray(v for p in px for v in p)), (2, 1, 1, 3, bytearray((250, 250, 250)))], "id long, height int, width int, channels int, data binary")
    assert rows(images.dominant_colour(df), "id", "b", "g", "r") == [(1, 30, 20, 200), (2, 250, 250, 250)]


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = n
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 1.0])
def test_components_match_flood_fill(share):
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 30), (25, 1), (23, 31)):
        mask = rng.random(shape) < share
        assert (images._components(mask) == flood(mask)).all()


def plain_merge(items, gap=12, most=0.36 * 800 * 1000):
    out, again = sorted(items), True
    while again:
        again = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                (p, q, r, s, t), (_, u, v, w, z) = out[i], out[j]
                if max(q, u) - min(q + s, u + w) > gap or max(r, v) - min(r + t, v + z) > gap:
                    continue
                x, y = min(q, u), min(r, v)
                wide, high = max(q + s, u + w) - x, max(r + t, v + z) - y
                if wide * high <= most:
                    out[i] = (p, x, y, wide, high)
                    del out[j]
                    again = True
                    break
            if again:
                break
    return sorted(out)


def test_merge_nearby_is_the_plain_rule(spark):
    rng = random.Random(2)
    pages = {p: [(k, rng.randint(0, 900), rng.randint(0, 700), rng.randint(5, 120), rng.randint(5, 120)) for k in range(40)] for p in range(6)}
    given = spark.createDataFrame([(p, *b) for p, items in pages.items() for b in items], BOX)
    got = boxes.merge_nearby(given).collect()
    for p, items in pages.items():
        assert sorted((r["box"], r["x"], r["y"], r["w"], r["h"]) for r in got if r["page"] == p) == plain_merge(items)


def test_mask_stats_and_normal_crop(spark):
    px = [(0, 0, 0, 0)] * 12 + [(10, 20, 30, 255)] * 24
    df = spark.createDataFrame([(1, 6, 6, 4, bytearray(v for p in px for v in p)), (2, 1, 1, 4, bytearray(4))], "id long, height int, width int, channels int, data binary")
    got = {r["id"]: r for r in images.mask_stats(df).collect()}
    assert (got[1]["pixels"], got[1]["y"], got[1]["h"], got[1]["median"]) == (24, 2, 4, [30, 20, 10]) and got[2]["pixels"] == 0
    ground, part = (230, 220, 190), (30, 20, 200)
    crop = [[part if 20 <= y < 40 and 30 <= x < 70 else ground for x in range(120)] for y in range(60)]
    crop[5][100] = part  # a speck
    df = spark.createDataFrame([(1, 60, 120, 3, bytearray(v for row in crop for p in row for v in p))], "id long, height int, width int, channels int, data binary")
    r = images.crop_normalize(df).first()
    out = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
    assert out.shape == (96, 96, 3)
    ys, xs = np.nonzero((out != 255).any(2))
    assert (xs.max() - xs.min() + 1, ys.max() - ys.min() + 1) == (40, 20) and (out[ys, xs] == part).all()


def test_page_structure(spark):
    page = np.full((420, 420, 3), 255, np.uint8)
    page[100:140, 200:210] = page[100:140, 215:225] = 0  # two strokes of a number in the middle
    page[300:310, 30:60] = (60, 120, 240)  # an orange arrow, in blue, green and red
    df = spark.createDataFrame([(1, 420, 420, 3, bytearray(page.tobytes()))], "id long, height int, width int, channels int, data binary")
    r = images.page_structure(df).first()
    assert (r["arrows"], r["dark"], r["groups"], r["strong"], r["central"], r["pixels"]) == (1, 2, 1, 1, 1, 800)
    scored = images.structure_scores(images.page_structure(df).withColumns({"window": F.lit(1), "page": F.lit(5), "first": F.lit(5), "last": F.lit(9)})).first()
    assert scored["score"] == 35 * 0.5 + 28 * 0.5 + 22 + 12 + 18 and scored["candidate_score"] == round(0.58 / 5 + 0.34 / 3 + 0.08 * 800 / 2400, 4) and not scored["candidate"]


def test_neighbours_of_a_missing_attribute(spark):
    kinds = "vec_id long, embedding array<double>, label int"
    catalog_rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 2)], kinds)
    asked = spark.createDataFrame([(10, [1.0, 0.1], 9), (11, [0.0, 1.0], 1), (12, [0.0, 0.0], 1)], kinds)
    got = sorted((r["query"], r["rank"], r["candidate"]) for r in catalog.knn_same_attr(asked, catalog_rows, k=2, cell_rows=1).collect())
    assert got == [(10, 1, 1), (10, 2, 3), (11, 1, 2), (11, 2, 1)]


def test_nearest_colours_of_a_large_palette(spark):
    rng = random.Random(6)
    palette = [(k, f"{rng.randrange(1 << 24):06x}") for k in range(3000)]
    asked = [(q, [rng.randrange(256) for _ in range(3)]) for q in range(40)] + [(99, None)]
    got = sorted((r["query"], r["rank"], r["color_id"]) for r in catalog.nearest_colours(spark.createDataFrame(asked, "query long, rgb array<int>"), spark.createDataFrame(palette, "color_id long, rgb string"), k=3, per_cell=4).collect())
    first = {}
    for k, c in palette:
        first.setdefault(c, k)
    want = []
    for q, rgb in asked[:-1]:
        near = sorted((sum((a - int(c[2 * i : 2 * i + 2], 16)) ** 2 for i, a in enumerate(rgb)), k) for c, k in first.items())[:3]
        want += [(q, n, k) for n, (_, k) in enumerate(near, 1)]
    assert got == sorted(want)


def test_deletes_beyond_a_thousand_patterns(spark):
    ids = [f"{n:012b}".replace("0", "a").replace("1", "b") for n in range(4096)]
    examples = spark.createDataFrame([(i,) for i in ids] + [(None,)], "example_id string")
    prefixes = [i.replace("a", "_") for i in ids[1:3000:2]] + ["bbbb" + "_" * 20, None]
    import re

    gone = {i for i in ids if any(re.fullmatch(p.replace("_", ".") + ".*", i) for p in prefixes[:40] if p)}
    got = {r["example_id"] for r in state.example_delete(examples, spark.createDataFrame([(p,) for p in prefixes[:40]], "prefix string"), like_compat=True).collect()}
    assert got == set(ids) - gone | {None}
    some = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    kept = {r["example_id"] for r in state.example_delete(examples, some, like_compat=True).collect()}
    assert kept == set(ids[::2]) | {None}
    long = spark.createDataFrame([("x" * n,) for n in range(1, 1500)], "example_id string")
    assert state.example_delete(long, spark.createDataFrame([("x" * n,) for n in range(1200, 1400)], "prefix string")).count() == 1199


def test_crop_ids_and_counts(spark):
    one = spark.range(1)
    assert one.select(scalars.first_version_id(F.lit("bag_01_page_010_step_8_015"), F.lit(None).cast("int"))).first()[0] == "p10_s8_c15"
    assert one.select(scalars.first_version_id(F.lit("bag_01_page_010_step_unknown_002"), F.lit(4))).first()[0] == "p10_s4_c2"
    assert one.select(scalars.first_version_id(F.lit("p1_s2_c3"), F.lit(None).cast("int"))).first()[0] == "p1_s2_c3"
    with pytest.raises(Exception, match="unknown step"):
        one.select(scalars.first_version_id(F.lit("bag_01_page_010_step_unknown_002"), F.lit(None).cast("int"))).collect()
    tokens = spark.createDataFrame([([("2x", 1, 1), ("2X", 5, 5), ("2x", None, 5), ("3x", 9, 9)],)], "t array<struct<text string, x int, y int>>")
    assert tokens.select(scalars.duplicate_tokens(F.col("t"))).first()[0] == 1
    assert one.select(scalars.stock_adjustment(F.lit(0), hide_depleted=True)).first()[0] is None


def test_sequence_evidence(spark):
    clusters = spark.createDataFrame([(1, 3, 8), (1, 20, 25)], "set_id long, start_page int, end_page int")
    found = spark.createDataFrame([(1, 3, 0.5), (1, 8, 1.0), (1, 12, 0.1), (1, 21, 0.7), (1, 1, 0.2)], "set_id long, page int, confidence double")
    assert rows(sequences.sequence_evidence(clusters, found), "bag", "confidence", "evidence") == [(1, 0.75, [3, 8]), (2, 0.7, [21])]


def test_first_box_and_visibility(spark):
    box = lambda x, w: {"x": x, "w": w, "h": 5}
    given = spark.createDataFrame([(1, 1, 5, "a", box(1, 0)), (1, 1, 5, "b", box(2, 9)), (1, 1, 5, "c", box(3, 9))], "set_id long, page int, value int, source string, box struct<x int, w int, h int>")
    none = spark.createDataFrame([], "set_id long, page int, value int")
    got = audits.merge_sources(given, none, box="box").first()
    assert got["sources"] == ["a", "b", "c"] and got["box"]["x"] == 2
    asked = spark.createDataFrame([(True, None), (False, True), (None, False), (None, None)], "a boolean, b boolean")
    assert [r[0] for r in asked.select(audits.callout_visibility(F.col("a"), F.col("b"))).collect()] == ["visible", "visible", "hidden", "unknown"]


def test_no_start_without_evidence(spark):
    kinds = "set_id long, page int, role string, allowed boolean, detected int, inferred int, inferred_source string, number_found boolean, number_area int, number_box struct<x int, y int, w int, h int>, card boolean, white_box boolean, strict_panel boolean, several_steps boolean, expected int, step_boxes array<struct<x int, y int, w int, h int>>"
    box = (0, 0, 10, 10)
    given = [
        (1, 1, "ambiguous", None, None, 1, "s", True, 50000, box, None, None, True, None, None, None),  # no number
        (1, 2, "ambiguous", None, 4, 1, "s", True, 50000, box, None, None, True, None, None, None),
        (1, 3, "ambiguous", None, 4, 1, "s", True, 30000, box, None, None, True, None, None, None),  # too small alone
        (1, 4, "ambiguous", None, 4, 1, "s", True, 30000, box, None, None, True, None, 4, None),  # expected
        (1, 5, "step_sequence_reset", True, None, 7, "s", None, None, None, None, None, True, None, None, None),  # inferred
        (1, 6, "ambiguous", True, 4, 1, "s", True, 50000, box, None, None, True, None, None, [(9, 9, 5, 5)]),
        (1, 7, "ambiguous", True, 4, 1, "s", True, None, box, None, None, None, None, None, [(10, 0, 5, 5)]),  # no pattern; boxes touch only
    ]
    got = {r["page"]: (r["bag"], r["layout"], r["reason"]) for r in acceptance.decide_starts(spark.createDataFrame(given, kinds)).collect()}
    assert got == {1: (None, "strict_top_left", "no_bag_number"), 2: (4, "strict_top_left", None), 3: (4, "strict_top_left", "number_box_area_too_small"), 4: (4, "strict_top_left", None), 5: (7, "transition_reset", None), 6: (4, "strict_top_left", "step_box_contaminates_bag_number"), 7: (4, None, "no_valid_bag_start_pattern")}


def test_catalog_rank_terms(spark):
    colors = spark.createDataFrame([(1, "Flat Silver", "101010"), (2, "Red", "101010"), (3, "Blue", "111111")], "color_id long, name string, rgb string")
    images_ = spark.createDataFrame([(7, 1, "a"), (8, 3, ""), (9, 3, "b")], "part_num long, color_id long, img_url string")
    asked = spark.createDataFrame([(1, 5, [16, 16, 16])], "query long, set_num long, rgb array<int>")
    pairs = spark.createDataFrame([], "set_num long, part_num long, color_id long")
    stock = spark.createDataFrame([(8, 3, 4), (9, 3, 0)], "part_num long, color_id long, remaining int")
    alike = spark.createDataFrame([(1, 8, 3, 0.5)], "query long, part_num long, color_id long, difference double")
    score = lambda **more: {r["part_num"]: r["score"] for r in catalog.catalog_rank(asked, images_, colors, pairs, stock, **more).collect()}
    far = round(3**0.5, 3)
    assert score() == {7: -5.0, 8: round(far - 30, 3), 9: round(far - 5 + 90, 3)}
    assert score(metallic=True, hide_depleted=True, similarity=alike) == {7: -13.0, 8: round(far - 30 + 4 + 12.5, 3)}


def test_catalog_rank_lists_each_colour_once(spark):
    """Against plain loops, with crops that share colours and sets whose own images are many, few or none; then many crops of one colour, in time."""
    colors = [(i, "Blue", f"{i * 37 % 256:02x}{i * 91 % 256:02x}{i * 53 % 256:02x}") for i in range(1, 15)]
    images_ = [(p, i, "" if p % 7 == 0 else "a") for i, *_ in colors for p in range(i % 3, 60, 1 + i % 4)]
    crops = [(q, q % 9, [q % 5 * 50, q % 4 * 60, 40]) for q in range(200)] + [(200, 1, None)]
    pairs = [(n, p, i) for n in range(6) for p, i, _ in images_ if (p * 31 + i) % (3 if n == 0 else 11 * n) == 0]
    stock = [(p, i, p % 3 - 1) for p, i, _ in images_ if p % 4 == 0]
    frames = [spark.createDataFrame(r, k) for r, k in ((crops, "query long, set_num long, rgb array<int>"), (images_, "part_num long, color_id long, img_url string"), (colors, "color_id long, name string, rgb string"), (pairs * 2, "set_num long, part_num long, color_id long"), (stock, "part_num long, color_id long, remaining int"))]
    own, left, want = set(pairs), {(p, i): n for p, i, n in stock}, []
    for k, most in ((20, 40), (4, 600)):
        got = catalog.catalog_rank(*frames, k=k, most=most)
        for q, n, rgb in crops[:-1]:
            near = sorted((sum((a - int(h[j : j + 2], 16)) ** 2 for a, j in zip(rgb, (0, 2, 4))) ** 0.5, i) for i, _, h in colors)[:6]
            far = {i: d for d, i in near}
            first = sorted((p, i, url) for p, i, url in images_ if i in far)[:most]
            rows = [(round(far[i] - (60 if (n, p, i) in own else 0) - (5 if url else 0) + (0 if (p, i) not in left else -30 if left[p, i] > 0 else 90), 3), p, i) for p, i, url in first]
            mine = [r for r in rows if (n, *r[1:]) in own]
            want += [(q, nth, p, i, score) for nth, (score, p, i) in enumerate(sorted(mine if len(mine) >= min(max(3, k // 2), k) else rows)[:k], 1)]
        assert [tuple(r) for r in got.orderBy("query", "rank").collect()] == want
        want = []
    images_wide = spark.range(2_000).select("id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("color_id")).selectExpr("id AS part_num", "cast(color_id AS long) AS color_id", "'a' AS img_url")
    many = spark.range(20_000).select(F.col("id").alias("query"), (F.col("id") + 100).alias("set_num"), F.array(F.lit(9), F.lit(9), F.lit(9)).alias("rgb"))
    began = time.perf_counter()
    assert catalog.catalog_rank(many, images_wide, *frames[2:]).count() == 400_000 and time.perf_counter() - began < 60  # 240 million rows, were each crop given its own list


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    """What rounds to zero from below is -0.0, in Spark and in the query's SQL alike."""
    given = [(1, [1.0, -1e-7, 1e-7, -0.0, 0.0], 0), (2, [-3.0, 4.0, -2.5e-6, -1e-5, 0.0], 0)]
    spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["f13_l2_normalize"](spark, str(tmp_path)).orderBy("vec_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert repr([tuple(r) for r in got]) == repr(con.execute(f"{registry.ORACLES['f13_l2_normalize']} ORDER BY vec_id").fetchall())
    assert [str(v) for v in got[0]["unit"]] == ["1.0", "-0.0", "0.0", "-0.0", "0.0"]


def test_element_lookup_grows_with_what_is_asked(spark):
    """Own sets, parts without a set or an inventory, unknown sets and elements; then one element that all sets list, in time."""
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    elements = frame([(10, 1, 1), (20, 2, 1), (30, 3, 1), (40, 4, 1), (50, 5, 1), (50, 6, 1)], "element_id long, part_num long, color_id long")
    requirements = frame([(1, 1, 1, 5), (1, 1, 1, 9), (2, 1, 1, 7), (3, 2, 1, 4), (99, 2, 1, 8), (4, 3, 1, 2), (1, 6, 1, 3)], "inventory_id long, part_num long, color_id long, quantity int")
    inventories = frame([(1, 100), (2, 100), (3, 200), (4, None)], "inventory_id long, set_num long")
    fallback = frame([(10, 7, 7, -1), (20, 7, 8, -1), (60, 7, 9, -1), (60, 7, 10, -1)], "element_id long, part_num long, color_id long, quantity int")
    asked = frame([(s, e) for s in (100, 200, None) for e in (10, 20, 30, 40, 50, 60, 70)], "set_num long, element_id long")
    got = {(r["set_num"], r["element_id"], r["color_id"] if r["element_id"] == 60 else None): (r["part_num"], r["quantity"]) for r in catalog.element_lookup(asked, elements, requirements, inventories, fallback).collect()}
    want = {100: [(1, 9), (2, 8), (3, 2), (4, None), (6, 3)], 200: [(7, -1), (2, 4), (3, 2), (4, None), (5, None)], None: [(7, -1), (7, -1), (None, None), (None, None), (None, None)]}
    want = {(s, e, None): hit for s, hits in want.items() for e, hit in zip((10, 20, 30, 40, 50), hits)} | {(s, 60, c): (7, -1) for s in (100, 200, None) for c in (9, 10)} | {(s, 70, None): (None, None) for s in (100, 200, None)}
    assert got == want
    sets = spark.range(20_000)
    began = time.perf_counter()
    rows = catalog.element_lookup(sets.selectExpr("id AS set_num", "10L AS element_id"), elements, sets.selectExpr("id AS inventory_id", "1L AS part_num", "1L AS color_id", "cast(id % 9 AS int) AS quantity"), sets.selectExpr("id AS inventory_id", "id AS set_num"), fallback)
    assert rows.filter("quantity = set_num % 9").count() == 20_000 and time.perf_counter() - began < 60  # 400 million rows, were each set given all rows of its parts


def test_section_parity_counts_in_one_pass(spark):
    """Against plain loops over rows that repeat and lack keys, ids, steps or quantities; and how often facts are shuffled."""
    rng = random.Random(7)
    some = lambda *of: rng.choice(of)
    make = lambda n, *columns: [(some(1, 1, 2, None), some(0, 1), *(some("a", "b", "c", "d", None) if c == "crop_id" else some(1, 2, 3, 4, None) for c in columns)) for _ in range(n)]
    kinds = {"crop_id": "crop_id string", "value": "value int", "qty": "qty int"}
    shape = [("crop_id",), ("crop_id", "value"), ("value",), ("value",), ("crop_id",), ("value",), ("crop_id", "qty"), ("crop_id", "qty")]
    tables = [make(n, *c) for n, c in zip((9, 12, 14, 12, 9, 9, 20, 20), shape)]
    frame = lambda rows, *columns: spark.createDataFrame(rows, ", ".join(("set_id long, bag int", *(kinds.get(c, f"{c} int") for c in columns))))
    sections = [(s, g, s, g) for s in (1, 2, 3) for g in (0, 1)] + [(None, 0, 1, 1)]
    found = [(1, 0, 1, 0), (1, 1, 1, 9), (3, 0, 3, 0), (None, 0, 1, 1)]
    old_ids, new_ids, expected, present, labels, visible, old_qty, new_qty = tables
    lacking = lambda s, g, rows, other, at=2, by=2: sum(r[:2] == (s, g) and (None in r or not any(o[:2] == (s, g) and o[by] == r[at] for o in other)) for r in rows)
    want = []
    for s, g, a, b in sections:
        counts = [0] * 6
        if s is not None:
            pairs = [(x, y) for x in old_qty for y in new_qty if x[:3] == y[:3] and x[:2] == (s, g) and None not in x]
            counts = [lacking(s, g, old_ids, new_ids), lacking(s, g, expected, present), lacking(s, g, present, expected), lacking(s, g, labels, new_ids), lacking(s, g, visible, new_ids, by=3), sum(x[3] != y[3] for x, y in pairs)]
        holds = s is not None and (s, g, a, b) in found
        want.append((s, g, holds, *counts, counts[1] + counts[2] == 0, holds and not any(counts)))
    frames = [frame(rows, *c) for rows, c in zip(tables, shape)]
    made = acceptance.section_parity(frame(sections, "start_page", "end_page"), frame(found, "start_page", "end_page"), tuple(frames[:2]), tuple(frames[2:4]), *frames[4:6], tuple(frames[6:]))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 4  # facts once; sections and what was found may move too

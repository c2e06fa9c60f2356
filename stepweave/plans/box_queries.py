"""Queries of the spatial operators."""

from __future__ import annotations

from stepweave.functions import scalars as f
from stepweave.operators import boxes as b
from stepweave.plans.base import register

F = b.F
_W, _H = 1000, 800


def _odd(i):
    return i.boxes.filter("box % 2 = 1")


def _even(i):
    return i.boxes.filter("box % 2 = 0")


register(
    "j11_nearby_qty", lambda i: b.nearby_qty(_odd(i), _even(i)),
    """WITH p AS (SELECT e.page, e.box, q.box AS qty_box, CAST(replace(q.text, 'x', '') AS INT) AS qty, e.y - q.y AS dy, abs((e.x + e.w / 2) - (q.x + q.w / 2)) AS dx, e.w FROM boxes e JOIN boxes q ON e.page = q.page AND e.box % 2 = 1 AND q.box % 2 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, box ORDER BY abs(dy - 14), dx, qty_box) AS rank FROM p WHERE dy >= -8 AND dy <= 60 AND dx <= greatest(70.0, w * 3.0)) SELECT page, box, rank, qty_box, qty FROM r WHERE rank <= 3""",
)
_MID = "p AS (SELECT c.page, c.box, t.box AS other, c.x + c.w / 2 AS cx, c.y + c.h / 2 AS cy, t.x + t.w / 2 AS tx, t.y + t.h / 2 AS ty FROM boxes c JOIN boxes t ON c.page = t.page AND c.box % 2 = 1 AND t.box % 2 = 0)"
register("j12_nearest_step_box", lambda i: b.nearest_step_box(_odd(i), _even(i)), f"WITH {_MID}, s AS (SELECT page, box, other, abs(floor(cx) - floor(tx)) + 1.5 * abs(floor(cy) - floor(ty)) AS score FROM p) SELECT page, box, other AS step_box, score FROM s QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY score, other) = 1")
_ISLE = f"{_MID}, isle AS (SELECT page, box, other AS island FROM p QUALIFY row_number() OVER (PARTITION BY page, box ORDER BY (cx - tx) ** 2 + (cy - ty) ** 2, other) = 1)"
register("j13_nearest_island", lambda i: b.nearest_island(_odd(i), _even(i)), f"WITH {_ISLE} SELECT * FROM isle")
register(
    "j14_island_binding",
    lambda i: b.island_binding(_odd(i).withColumn("preset", F.expr("if(x % 7 = 0, 100, null)")), _odd(i).filter("x % 5 = 0").select("page", "box", F.lit(200).alias("island")), b.nearest_island(_odd(i), _even(i)), i.boxes.select("page", "box", F.lit(300).alias("island")).filter("box = 1")),
    f"WITH {_ISLE} SELECT o.page, o.box, CASE WHEN o.x % 7 = 0 THEN 100 WHEN o.x % 5 = 0 THEN 200 WHEN n.island IS NOT NULL THEN n.island WHEN o.box = 1 THEN 300 END AS island, CASE WHEN o.x % 7 = 0 THEN 'preset' WHEN o.x % 5 = 0 THEN 'verdict' WHEN n.island IS NOT NULL THEN 'nearest' WHEN o.box = 1 THEN 'ordinal' ELSE 'none' END AS source FROM boxes o LEFT JOIN isle n USING (page, box) WHERE o.box % 2 = 1",
)
register(
    "j16_box_overlaps", lambda i: b.box_overlaps(_wide(_odd(i)), _wide(_even(i))),
    """WITH v AS (SELECT page, box, x, y, w * 9 AS w, h * 9 AS h FROM boxes), o AS (SELECT a.page, a.box AS left_box, c.box AS right_box, (least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * (least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS shared, a.w * a.h + c.w * c.h AS both_areas
    FROM v a JOIN v c ON a.page = c.page AND a.box % 2 = 1 AND c.box % 2 = 0 AND a.x < c.x + c.w AND c.x < a.x + a.w AND a.y < c.y + c.h AND c.y < a.y + a.h) SELECT page, left_box, right_box, shared, shared / (both_areas - shared) AS iou FROM o""",
)


def _wide(df):
    return df.withColumn("w", F.col("w") * 9).withColumn("h", F.col("h") * 9)


register("f14_box_functions", lambda i: i.boxes.select("page", "box", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("w") * F.col("h")).alias("area"), F.least(F.col("x") + F.col("w"), F.lit(_W)).alias("clipped")), f"SELECT page, box, x + w / 2 AS cx, w * h AS area, least(x + w, {_W}) AS clipped FROM boxes")
register("j15_greedy_assign", lambda i: b.greedy_assign(_odd(i), _even(i)))
register("u06_iou_dedupe", lambda i: b.iou_dedupe(_wide(i.boxes).withColumn("step", F.expr("box % 3"))))
register("u07_nms_score", lambda i: b.nms_score(_wide(i.boxes)))
register("u08_nms_text", lambda i: b.nms_text(_wide(i.boxes)))
register("u09_merge_nearby", lambda i: b.merge_nearby(i.boxes))
register("w29_row_grouping", lambda i: b.row_grouping(i.boxes))
register(
    "w28_adjacent_join", lambda i: b.adjacent_join(i.boxes, gap=200),
    """WITH l AS (SELECT *, x - (lag(x) OVER w + lag(w) OVER w) AS apart, abs((y + h / 2) - (lag(y) OVER w + lag(h) OVER w / 2)) AS dy, greatest(h, lag(h) OVER w) AS tall FROM boxes WINDOW w AS (PARTITION BY page ORDER BY y, x, box)),
    g AS (SELECT *, sum(CASE WHEN apart BETWEEN -4 AND 200 AND dy <= 0.5 * tall THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y, x, box) AS grp FROM l)
    SELECT page, grp::BIGINT AS "group", string_agg(text, '' ORDER BY x, box) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS parts FROM g GROUP BY page, grp""",
)
register("p06_valid_step_number", lambda i: i.page_steps.select("set_id", "page", b.valid_step_number(F.col("value") * 5 - 20).alias("v")).select("set_id", "page", "v.value", "v.reason"), "WITH v AS (SELECT set_id, page, value * 5 - 20 AS v FROM page_steps), r AS (SELECT *, CASE WHEN v <= 0 THEN 'not positive' WHEN v >= 1000 THEN 'four digits' WHEN v > 200 THEN 'above limit' END AS reason FROM v) SELECT set_id, page, CASE WHEN reason IS NULL THEN v END AS value, reason FROM r")
_MED = "med AS (SELECT page, median(h) AS mh, median(w * h) AS ma FROM boxes GROUP BY page)"
register("p07_valid_step_region", lambda i: b.valid_step_region(i.boxes, _W, _H).select("page", "box"), f"WITH {_MED} SELECT page, box FROM boxes JOIN med USING (page) WHERE x < {_W} * 0.45 AND y < {_H} * 0.88 AND (h >= mh * 1.15 OR w * h >= ma * 1.4)")
register("p08_page_number_token", lambda i: i.boxes.filter(b.page_number_token(F.col("x"), F.col("y"), _W, _H)).select("page", "box"), f"SELECT page, box FROM boxes WHERE y >= {_H} * 0.88 AND (x <= {_W} * 0.18 OR x >= {_W} * 0.82)")
_F10 = f"round_even(least(3.0, h / mh) + least(3.0, w * h / ma) + greatest(0.0, 2.0 - x / ({_W} * 0.16)) + greatest(0.0, 1.25 - y / ({_H} * 0.88)) - 0.5 + 1e-9, 3)"
register("f10_step_candidate_score", lambda i: b.step_candidate_score(i.boxes, _W, _H).select("page", "box", "score"), f"WITH {_MED} SELECT page, box, ({_F10})::DOUBLE AS score FROM boxes JOIN med USING (page)")
register(
    "w30_main_sub_split", lambda i: b.main_sub_split(i.boxes, _W),
    f"""WITH a AS (SELECT page, box, x, w * h AS area, score, x <= min(x) OVER (PARTITION BY page) + 60 AS band FROM boxes), t AS (SELECT *, max(CASE WHEN band THEN area END) OVER (PARTITION BY page) AS ta, max(CASE WHEN band THEN score END) OVER (PARTITION BY page) AS ts FROM a),
    r AS (SELECT page, box, CASE WHEN band AND (area >= ta * 0.55 OR score >= ts - 0.75) THEN 'main' WHEN x <= {int(_W * 0.35)} THEN 'sub' END AS role FROM t) SELECT * FROM r WHERE role IS NOT NULL""",
)
register(
    "a06_ocr_vote", lambda i: b.ocr_vote(i.votes),
    """WITH v AS (SELECT key, value, count(*) AS n, max(confidence) AS best, arg_max(text, (confidence, text)) AS text FROM votes GROUP BY ALL), t AS (SELECT *, best + 4.0 * (n - 1) + 40.0 * (length(text) - 1) AS total FROM v)
    SELECT key, value, text, total FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY total DESC, best DESC, length(text) DESC, n DESC, value DESC) = 1""",
)
register("a07_median_band", lambda i: b.median_band(i.boxes.select("page", "box", "h"), "page", "h"), "WITH m AS (SELECT page, median(h) AS median FROM boxes GROUP BY page) SELECT page, box, h, median, h < median * 0.7 OR h > median * 1.3 AS outlier, h < median - 10 AS narrow FROM boxes JOIN m USING (page)")
register("a09_signal_profile", lambda i: b.signal_profile(i.bundles.join(i.labels, "doc_id"), "quality", ["n_chars", "toxic"]), "WITH j AS (SELECT quality AS class, n_chars, toxic FROM bundles JOIN labels USING (doc_id)), u AS (SELECT class, 'n_chars' AS signal, n_chars::DOUBLE AS value FROM j UNION ALL SELECT class, 'toxic', toxic::DOUBLE FROM j) SELECT class, signal, min(value) AS low, median(value) AS median, max(value) AS high FROM u GROUP BY ALL")
register("a18_overview_spread", lambda i: b.overview_spread(i.boxes, "text"), "WITH s AS (SELECT *, CAST(y - lag(y) OVER (PARTITION BY page ORDER BY y, box) > 100 AS INT) AS step FROM boxes) SELECT page, count(DISTINCT text) AS numbers, max(x) - min(x) AS x_spread, max(y) - min(y) AS y_spread, (coalesce(sum(step), 0) + 1)::BIGINT AS bands FROM s GROUP BY page")
register("t09_visual_order", lambda i: b.visual_order(i.boxes.select("page", "box", "x", "y")), "SELECT page, box, x, y, row_number() OVER (PARTITION BY page ORDER BY y, x, box) AS nth FROM boxes")
register("t07_best_detection", lambda i: b.best_detection(i.boxes, "page"), "SELECT page, box, score FROM boxes QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, w * h DESC, w DESC, box DESC) = 1")
register("t06_even_sample", lambda i: b.even_sample(i.page_steps, "set_id", "page", 9), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY page) - 1 AS nth, count(*) OVER (PARTITION BY set_id) AS size FROM page_steps) SELECT set_id, page, value FROM r WHERE size <= 9 OR list_contains([round_even(k * (size - 1) / 8.0, 0)::INT FOR k IN range(0, 9)], nth::INT)")
# scalar functions over whole tables
register("f01_parse_bundle_id", lambda i: i.bundles.select("bundle_id", f.bundle_fields(F.col("bundle_id")).alias("f")).select("bundle_id", "f.*"), "SELECT bundle_id, regexp_extract(bundle_id, '^(.+)_bag', 1) AS set_num, regexp_extract(bundle_id, '_bag([0-9]+)_', 1)::INT AS bag, regexp_extract(bundle_id, '_p([0-9]+)_', 1)::INT AS page, regexp_extract(bundle_id, '_s([0-9]+)_', 1)::INT AS step, regexp_extract(bundle_id, '_c([0-9]+)$', 1)::INT AS crop FROM bundles")
register("f02_parse_crop_id", lambda i: i.boxes.select(f.crop_id(F.col("page"), F.col("box"), F.col("w")).alias("id")).select("id", f.crop_fields(F.col("id")).alias("f")).select("id", "f.*"), "SELECT concat('p', page, '_s', box, '_c', w) AS id, page::INT AS page, box AS step, w AS crop FROM boxes")
register("f03_parse_qty", lambda i: i.boxes.select("page", "box", f.parse_qty(F.col("text"), high=40).alias("qty"), f.strict_qty(F.col("text")).alias("strict"), f.text_qty(F.concat(F.lit("take "), "text", F.lit(" of x7"))).alias("free")), "SELECT page, box, CASE WHEN replace(text, 'x', '')::INT BETWEEN 1 AND 40 THEN replace(text, 'x', '')::INT END AS qty, replace(text, 'x', '')::INT AS strict, 7 AS free FROM boxes")
register("f04_qty_sequence", lambda i: i.bundles.select("doc_id", F.transform(f.qty_sequence(F.expr("sequence(1, cast(doc_id % 4 + 1 as int))"), F.expr("if(doc_id % 2 = 0, array('a'), array('b', 'c'))")), lambda q: q["text"]).alias("texts")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['a'] || [concat(k, 'x') FOR k IN range(2, doc_id % 4 + 2)] ELSE ['b', 'c'] || [concat(k, 'x') FOR k IN range(3, doc_id % 4 + 2)] END AS texts FROM bundles")
register("f06_hex_rgb", lambda i: i.colors.select("color_id", f.hex_rgb(F.col("rgb")).alias("c"), F.get(f.hex_rgb(F.lit("zz"), "black"), F.lit(0)).alias("black")), "SELECT color_id, [('0x' || rgb[1:2])::INT, ('0x' || rgb[3:4])::INT, ('0x' || rgb[5:6])::INT] AS c, 0 AS black FROM colors")
register("f07_rgb_distance", lambda i: i.colors.select("color_id", F.bround(f.rgb_similarity(f.rgb_distance(f.hex_rgb(F.col("rgb")), F.array(F.lit(10), F.lit(20), F.lit(30)))), 6).alias("score")), "SELECT color_id, round_even(greatest(0, least(1, 1 - sqrt((('0x' || rgb[1:2])::INT - 10) ** 2 + (('0x' || rgb[3:4])::INT - 20) ** 2 + (('0x' || rgb[5:6])::INT - 30) ** 2) / 441.6729::DOUBLE)), 6) AS score FROM colors")
register("f11_avg_hash", lambda i: i.vectors.select("vec_id", f.avg_hash(F.expr("transform(embedding, x -> floor(x * 1000))")).alias("h")), "WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v * 1000::FLOAT)::DOUBLE) AS g FROM vectors), u AS (SELECT vec_id, unnest(g) AS v, generate_subscripts(g, 1) AS k, list_sum(g) / len(g) AS m FROM g) SELECT vec_id, (sum(CASE WHEN v >= m THEN CASE WHEN k = 64 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (k - 1)::INT END ELSE 0 END))::BIGINT AS h FROM u GROUP BY vec_id")
register("f13_l2_normalize", lambda i: i.vectors.select("vec_id", F.transform(f.l2_normalize(F.col("embedding")), lambda v: f.round_even(v, 6)).alias("unit")), "SELECT vec_id, list_transform(embedding, lambda v: round_even(v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)) AS unit FROM vectors")
register("f15_ocr_variants", lambda i: i.page_steps.select("set_id", "page", "value", f.ocr_variants(F.col("value")).alias("variants")), "WITH t AS (SELECT set_id, page, value, value::VARCHAR AS v FROM page_steps) SELECT set_id, page, value, list_sort(list_distinct(list_transform(list_filter(range(1, len(v) + 1), lambda i: contains('72835610', v[i])), lambda i: (v[1:i - 1] || translate(v[i], '72835610', '27386578') || v[i + 1:])::INT))) AS variants FROM t")
register("f16_text_counts", lambda i: i.documents.select("doc_id", f.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*"), "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS words, len(regexp_extract_all(text, '[A-Za-z]{5,}')) AS long_words, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents")
register("f17_safe_key", lambda i: i.bundles.select("doc_id", f.safe_key(F.expr("if(doc_id % 3 = 0, '*/ ', concat(source, '/', bundle_id))")).alias("key")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE concat(source, bundle_id) END AS key FROM bundles")
register("f18_stock_adjustment", lambda i: i.examples.select("event_id", f.stock_adjustment(F.col("qty")).alias("adjustment")), "SELECT event_id, CASE WHEN qty > 0 THEN -30.0 WHEN qty IS NOT NULL THEN 90.0 ELSE 0.0 END AS adjustment FROM examples")
register("f19_iso_timestamp", lambda i: i.events.select("event_id", f.iso_timestamp(F.col("ts")).alias("iso")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
register("p01_safe_coerce", lambda i: i.events.select("event_id", f.safe_int(F.expr("case when event_id % 3 = 0 then '' when event_id % 3 = 1 then concat(event_id, '.0') else concat(' ', event_id) end")).alias("n")), "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN event_id END AS n FROM events")
register("p11_set_id_normalize", lambda i: i.bundles.select("doc_id", f.with_suffix(F.expr("if(doc_id % 2 = 0, concat(doc_id, '-2'), cast(doc_id as string))")).alias("full"), f.without_suffix(F.expr("concat(doc_id, '-2')")).alias("bare")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(doc_id, '-2') ELSE concat(doc_id, '-1') END AS full, doc_id::VARCHAR AS bare FROM bundles")


def _neighbours(i):
    """Each box with the next one of its page."""
    w = b.Window.partitionBy("page").orderBy("box")
    return i.boxes.select("page", "box", *(F.col(c).alias(f"a_{c}") for c in "xywh"), *(F.lead(c).over(w).alias(f"b_{c}") for c in "xywh")).filter("b_x IS NOT NULL")


register(
    "f14_box_relations",
    lambda i: _neighbours(i).select("page", "box", f.inside("a_", "b_", 400).alias("inside"), f.holds_point("a_", F.col("b_x"), F.col("b_y")).alias("holds"), f.centre_distance("a_", "b_").alias("distance"), f.intersection_area("a_", "b_").alias("shared"), f.overlaps("a_", "b_").alias("overlap"), f.clipped("a_", 500, 400)["w"].alias("clipped_w")),
    """WITH n AS (SELECT page, box, x, y, w, h, lead(x) OVER k AS bx, lead(y) OVER k AS bby, lead(w) OVER k AS bw, lead(h) OVER k AS bh FROM boxes WINDOW k AS (PARTITION BY page ORDER BY box))
    SELECT page, box, x >= bx - 400 AND y >= bby - 400 AND x + w <= bx + bw + 400 AND y + h <= bby + bh + 400 AS inside, bx BETWEEN x AND x + w AND bby BETWEEN y AND y + h AS holds, sqrt((x + w / 2 - bx - bw / 2) ** 2 + (y + h / 2 - bby - bh / 2) ** 2) AS distance,
        greatest(least(x + w, bx + bw) - greatest(x, bx), 0) * greatest(least(y + h, bby + bh) - greatest(y, bby), 0) AS shared, x < bx + bw AND bx < x + w AND y < bby + bh AND bby < y + h AS overlap, CASE WHEN least(x + w, 500) > x AND least(y + h, 400) > y THEN least(x + w, 500) - x END AS clipped_w FROM n WHERE bx IS NOT NULL""",
)
register("f03_duplicate_tokens", lambda i: i.boxes.groupBy("page").agg(F.collect_list(F.struct("text", F.expr("if(box % 4 = 0, null, x)").alias("x"), "y")).alias("t")).select("page", f.duplicate_tokens(F.col("t")).alias("duplicates")), "SELECT page, (count(*) FILTER (WHERE box % 4 <> 0) - count(DISTINCT text) FILTER (WHERE box % 4 <> 0))::INT AS duplicates FROM boxes GROUP BY page")
register("f18_hidden_when_depleted", lambda i: i.examples.select("event_id", f.stock_adjustment(F.col("qty"), hide_depleted=True).alias("adjustment")).filter("adjustment IS NOT NULL"), "SELECT event_id, CASE WHEN qty > 0 THEN -30.0 ELSE 0.0 END AS adjustment FROM examples WHERE qty > 0 OR qty IS NULL")
register("f02_first_version_id", lambda i: i.boxes.select("page", "box", f.first_version_id(F.format_string("bag_%02d_page_%03d_step_%s_%03d", F.col("x") % 9, F.col("page"), F.expr("if(box % 3 = 0, 'unknown', cast(box as string))"), F.col("w")), F.col("h")).alias("id")), "SELECT page, box, concat('p', page, '_s', CASE WHEN box % 3 = 0 THEN h ELSE box END, '_c', w) AS id FROM boxes")
register(
    "a18_overview_pages", lambda i: b.overview_pages(i.boxes, "text", 1000, 800).select("page", "x_bands", "y_bands", "overview"),
    """WITH c AS (SELECT page, text, x + w * 0.5::DOUBLE AS cx, y + h * 0.5::DOUBLE AS cy FROM boxes), s AS (SELECT *, cx - lag(cx) OVER (PARTITION BY page ORDER BY cx) > 120 AS sx, cy - lag(cy) OVER (PARTITION BY page ORDER BY cy) > 96 AS sy FROM c),
    g AS (SELECT page, count(*) AS n, count(DISTINCT text) AS numbers, max(cx) - min(cx) AS xs, max(cy) - min(cy) AS ys, count(*) FILTER (WHERE sx) + 1 AS x_bands, count(*) FILTER (WHERE sy) + 1 AS y_bands FROM s GROUP BY page)
    SELECT page, x_bands, y_bands, n >= 4 AND ((numbers >= 2 AND xs >= 350 AND ys >= 80 AND (x_bands >= 2 OR y_bands >= 2)) OR (numbers >= 4 AND xs >= 450 AND ys >= 120 AND x_bands >= 2 AND y_bands >= 2)) AS overview FROM g""",
)
register("f19_json_safe", lambda i: i.events.select("event_id", f.json_safe(F.struct("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("if(event_id % 2 = 0, null, event_type)").alias("kind"))).alias("json")), "SELECT event_id, concat('{\"event_id\":', event_id, ',\"ts\":\"', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '\",\"kind\":', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE concat('\"', event_type, '\"') END, '}') AS json FROM events")

"""Queries of suspect steps and repairs."""

from __future__ import annotations

from stepweave.operators import repairs as r
from stepweave.plans.base import register
from stepweave.sources import files

F = r.F
register("w15_suspect_steps", lambda i: r.suspect_steps(i.page_steps))
_NEAR = "pg AS (SELECT set_id, page, min(value) AS low, max(value) AS high, count(*) = 1 AS alone FROM multi_steps GROUP BY ALL), nb AS (SELECT set_id, page, alone, lag(high) OVER w AS prev_step, lead(low) OVER w AS next_step FROM pg WINDOW w AS (PARTITION BY set_id ORDER BY page))"
register("w16_page_neighbours", lambda i: r.page_neighbours(i.multi_steps.select("set_id", "page", "value")), f"WITH {_NEAR} SELECT m.set_id, m.page, m.value, nb.alone, nb.prev_step, nb.next_step FROM multi_steps m JOIN nb USING (set_id, page)")


def _rows(i):
    return r.page_neighbours(i.multi_steps.select("set_id", "page", "value", "h")).withColumn("id_step", F.expr("if(h % 5 = 0, value + 1, value)")).withColumn("nearest", F.expr("if(h % 3 = 0, h % 13, null)"))


# single digits only: the confused digits of 1..13 are 2 -> 7, 3 -> 8, 5 -> 6, 7 -> 2, 1 -> 7, and in 11 and 13 one of them at a time
_VAR = "CASE value WHEN 1 THEN [7] WHEN 3 THEN [8] WHEN 5 THEN [6] WHEN 7 THEN [2] WHEN 9 THEN [] WHEN 11 THEN [17, 71] WHEN 13 THEN [18, 73] END"
register(
    "w16_propose_step", lambda i: r.propose_step(_rows(i)),
    f"""WITH {_NEAR}, m AS (SELECT m.set_id, m.page, m.value, nb.alone, nb.prev_step AS p, nb.next_step AS n, CASE WHEN h % 5 = 0 THEN value + 1 ELSE value END AS id_step, CASE WHEN h % 3 = 0 THEN h % 13 END AS nearest, {_VAR} AS variants FROM multi_steps m JOIN nb USING (set_id, page)),
    f AS (SELECT *, list_filter(variants, lambda v: (p IS NULL OR v > p) AND (n IS NULL OR v < n))[1] AS fit, p + greatest(1, (n - p) // 2) AS middle FROM m),
    k AS (SELECT *, CASE WHEN id_step <> value AND (p IS NULL OR value > p) AND (n IS NULL OR value < n) THEN 1 WHEN n - p = 2 THEN 2 WHEN alone AND n - p > 0 AND n - p <= 12 AND middle < n THEN 3 WHEN nearest > 0 AND (p IS NULL OR nearest > p) AND (n IS NULL OR nearest < n) THEN 4 WHEN fit IS NOT NULL THEN 5 WHEN p IS NOT NULL AND (n IS NULL OR p + 1 < n) THEN 6 ELSE 7 END AS rule_no FROM f)
    SELECT set_id, page, value, CASE rule_no WHEN 1 THEN value WHEN 2 THEN p + 1 WHEN 3 THEN middle WHEN 4 THEN nearest WHEN 5 THEN fit WHEN 6 THEN p + 1 END AS step, CASE rule_no WHEN 1 THEN 0.93 WHEN 2 THEN CASE WHEN list_contains(variants, p + 1) OR p + 1 = value THEN 0.98 ELSE 0.95 END WHEN 3 THEN 0.82 WHEN 4 THEN 0.72 WHEN 5 THEN 0.68 WHEN 6 THEN 0.55 ELSE 0.0 END AS confidence,
    CASE rule_no WHEN 1 THEN 'record_step_fits_sequence' WHEN 2 THEN 'sequence_gap_fill' WHEN 3 THEN 'interpolate_between_neighbour_pages' WHEN 4 THEN 'nearest_detected_step_box' WHEN 5 THEN 'ocr_variant_in_sequence_window' WHEN 6 THEN 'fallback_prev_plus_one' ELSE 'unresolved' END AS rule FROM k""",
)
register(
    "f09_page_confidence",
    lambda i: i.page_steps.select("set_id", "page", r.page_confidence(*(F.expr(e) for e in ("page % 2 = 0", "page % 3 = 0", "page % 5 < 2", "value % 2 = 0", "if(value % 3 = 0, null, value)", "if(page % 4 = 0, null, value / 100.0D)", "if(page % 7 = 0, null, cast(value - 60 as double))"))).alias("confidence")),
    "SELECT set_id, page, round_even(least(1.0, CASE WHEN page % 2 = 0 THEN 0.15 ELSE 0.0 END + CASE WHEN page % 3 = 0 THEN 0.20 + coalesce(CASE WHEN page % 4 = 0 THEN NULL ELSE least(1.0, value / 100.0) END * 0.15, 0.0) ELSE 0.0 END + CASE WHEN page % 5 < 2 THEN 0.25 + coalesce(CASE WHEN page % 7 = 0 THEN NULL ELSE greatest(0.0, least(1.0, (value - 60 + 40) / 80.0)) END * 0.15, 0.0) ELSE 0.0 END + CASE WHEN value % 2 = 0 THEN 0.10 ELSE 0.0 END + CASE WHEN value % 3 = 0 THEN -0.30 ELSE 0.40 END) + 1e-9, 3)::DOUBLE AS confidence FROM page_steps",
)
register(
    "f22_token_rebase", lambda i: r.token_rebase(i.boxes.selectExpr("concat(page, '_', box) as id", "cast(x + 100 as double) as x", "cast(y + 50 as double) as y", "w", "h", "300 as cw", "200 as ch", "150 as cx", "100 as cy")),
    """WITH t AS (SELECT concat(page, '_', box) AS id, x + 100 AS x, y + 50 AS y, w, h FROM boxes), l AS (SELECT id, x, y, w, h, least(300, x) AS a, least(200, y) AS b, least(300, x + w) AS c, least(200, y + h) AS d, greatest(0, least(300, x - 150)) AS e, greatest(0, least(200, y - 100)) AS f, greatest(0, least(300, x - 150 + w)) AS g, greatest(0, least(200, y - 100 + h)) AS k FROM t)
    SELECT id, CASE WHEN c > a AND d > b THEN [a, b, c - a, d - b] ELSE [e, f, g - e, k - f] END AS box, CASE WHEN c > a AND d > b THEN 'crop_local_xywh' ELSE 'page_xywh_minus_crop_origin' END AS source FROM l WHERE (c > a AND d > b) OR (x >= 150 AND y >= 100 AND g > e AND k > f)""",
)


def _grids(i, when):
    grey = F.expr("transform(embedding, x -> floor((x + 1) * 100))")
    return i.vectors.filter(when).select(F.col("label").alias("set_num"), F.col("vec_id").alias("id"), grey.alias("grey"), F.expr("array(cast(vec_id % 256 as int), cast(vec_id * 7 % 256 as int), 9)").alias("rgb"))


register("f12_library_match", lambda i: r.library_match(_grids(i, "vec_id % 50 = 0"), _grids(i, "true")))


def _gate(i):
    return i.boxes.selectExpr("l_suppkey as set_id", "page", "box * 4 as value", "case when x % 9 > 0 then x % 4 end as components", "w * 2 as w", "h + 10 as h", "score", "case when x % 5 = 0 then false when x % 5 < 3 then true end as plausible", "y % 7 = 0 as substep", "y % 11 = 0 as misread")


register(
    "w25_cluster_gate", lambda i: r.cluster_gate(_gate(i)),
    """WITH d AS (SELECT l_suppkey AS set_id, page, box * 4 AS value, CASE WHEN x % 9 > 0 THEN x % 4 END AS components, w * 2 AS w, h + 10 AS h, CASE WHEN x % 5 = 0 THEN false WHEN x % 5 < 3 THEN true END AS ok, y % 7 = 0 AS substep, y % 11 = 0 AS misread FROM boxes),
    f AS (SELECT *, CASE WHEN components IS NULL THEN 'uncertain' WHEN components = 1 OR w < 30 OR h < 25 OR h > 60 OR (value >= 10 AND value < 100 AND components <> 2) THEN 'reject' WHEN components = 2 THEN 'pass' ELSE 'uncertain' END AS fit FROM d)
    SELECT set_id, page, value, fit, CASE WHEN misread THEN 'misread' WHEN substep AND fit <> 'reject' AND coalesce(ok, true) THEN 'substep' WHEN NOT coalesce(ok, true) OR fit = 'reject' THEN 'noise' WHEN fit = 'pass' AND coalesce(ok, false) THEN 'accepted' ELSE 'human_review' END AS decision FROM f""",
)
register(
    "f05_slot_sequence", lambda i: r.slot_sequence(i.bundles.selectExpr("doc_id as crop", "if(doc_id % 3 = 0, array('1x', '2x'), array()) as qty", "if(doc_id % 2 = 0, array(cast(doc_id % 4 as int)), array()) as saved", "cast(doc_id % 5 as int) as islands")),
    """WITH s AS (SELECT doc_id AS crop, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN doc_id % 4 + 1 ELSE 0 END AS first, CASE WHEN doc_id % 3 = 0 THEN 'qty' WHEN doc_id % 2 = 0 THEN 'saved_label' ELSE 'island_fallback' END AS source, CASE WHEN doc_id % 5 <= 3 THEN doc_id % 5 ELSE 0 END AS island FROM bundles),
    x AS (SELECT *, unnest(range(0, greatest(first, island))) AS slot FROM s) SELECT crop, slot, CASE WHEN slot < first THEN source ELSE 'island_fallback' END AS source FROM x""",
)
register(
    "s09_embedding_scan", lambda i: files.embedding_scan(i.vectors.select("vec_id", "embedding"), i.vectors.select("vec_id", "label")).select("vec_id", "label", "length", F.bround(F.element_at("embedding", -1).cast("double"), 6).alias("last")),
    "SELECT vec_id, label, len(embedding) AS length, round_even(embedding[-1]::DOUBLE, 6) AS last FROM vectors",
)

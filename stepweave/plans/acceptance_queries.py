"""Queries of section acceptance, crop ids, misread numbers and parity of two runs."""

from __future__ import annotations

from stepweave.operators import acceptance as a, pages as p, sequences as q
from stepweave.plans.base import register
from stepweave.plans.page_queries import _ROLES
from stepweave.session import cut

F = a.F


def _starts(i):
    roles = p.transition_role(q.step_roles(i.page_steps), F.col("page") % 2 == 0).select("set_id", "page", "role")
    inferred = q.infer_number(i.page_steps.select("set_id", "page"), i.truth).select("set_id", "page", F.col("bag").alias("inferred"), F.col("source").alias("inferred_source"))
    boxes = i.evidence.selectExpr("*", "named_struct('x', nx, 'y', ny, 'w', 60, 'h', 40) AS number_box", "if(page % 3 = 0, array(named_struct('x', sx, 'y', sy, 'w', 20, 'h', 20)), array()) AS step_boxes")
    return a.decide_starts(boxes.join(roles, ["set_id", "page"]).join(inferred, ["set_id", "page"]))


register(
    "p17_section_acceptance", _starts,
    f"""WITH {_ROLES}, tr AS (SELECT set_id, page, CASE WHEN hero AND role <> 'step_sequence_reset' AND page % 2 = 0 THEN 'hero_transition_reset' ELSE role END AS role FROM ro),
    own AS (SELECT set_id, page, min(bag) AS bag FROM truth GROUP BY ALL),
    inf AS (SELECT s.set_id, s.page, o.bag IS NOT NULL AS same, coalesce(o.bag, coalesce(t.bag, 0) + 1) AS inferred FROM page_steps s ASOF LEFT JOIN truth t ON s.set_id = t.set_id AND s.page > t.page LEFT JOIN own o ON o.set_id = s.set_id AND o.page = s.page),
    x AS (SELECT e.*, role, same, role IN ('step_sequence_reset', 'hero_transition_reset') AS rst, CASE WHEN white_box THEN inferred END AS wb, inferred FROM evidence e JOIN tr USING (set_id, page) JOIN inf USING (set_id, page)),
    y AS (SELECT *, CASE WHEN detected IS NULL AND wb IS NULL AND rst AND strict_panel THEN inferred END AS rb FROM x),
    z AS (SELECT *, coalesce(wb, detected, rb) AS bag, wb IS NOT NULL AS by_white, rst AND coalesce(wb, detected, rb) IS NOT NULL AND (number_found OR rb IS NOT NULL) AS by_reset, strict_panel AND number_found AS by_strict FROM y),
    k AS (SELECT *, CASE WHEN by_white THEN 'white_box_transition' WHEN card THEN 'card' WHEN by_reset AND role = 'hero_transition_reset' THEN role WHEN by_reset THEN 'transition_reset' WHEN by_strict THEN 'strict_top_left' END AS layout FROM z),
    r AS (SELECT *, CASE WHEN bag IS NULL THEN 'no_bag_number' WHEN several_steps THEN 'multi_step_green_boxes' WHEN (role = 'build_step_sequence_page' OR NOT allowed) AND NOT by_white THEN 'build_step_sequence_page' WHEN NOT number_found AND NOT by_reset AND NOT by_white THEN 'no_number_box'
        WHEN number_area <= CASE WHEN expected IS NULL THEN 40000 ELSE 20000 END AND NOT (card OR by_reset OR by_white) THEN 'number_box_area_too_small' WHEN page % 3 = 0 AND sx < nx + 60 AND nx < sx + 20 AND sy < ny + 40 AND ny < sy + 20 THEN 'step_box_contaminates_bag_number' WHEN layout IS NULL THEN 'no_valid_bag_start_pattern' END AS reason FROM k)
    SELECT set_id, page, bag, layout, CASE WHEN by_white OR rb IS NOT NULL THEN CASE WHEN same THEN 'existing_truth_same_page' ELSE 'last_confirmed_bag_sequence' END END AS source, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS decision, reason FROM r""",
)

_ENTRY = "page * 10 + box AS entry, CASE WHEN box % 5 = 0 THEN concat('own', CAST(page AS VARCHAR(20))) WHEN box % 5 = 1 THEN ' ' END AS crop_id, page, box % 3 AS step, x, y, w, h, CASE WHEN box % 2 = 0 THEN box END AS crop_index FROM boxes"
_LABEL = "concat('lab', CAST(page AS VARCHAR(20)), '_', CAST(box AS VARCHAR(20))) AS crop_id, page, box % 3 AS step, x + (box % 4) * 4 AS x, y, w, h, box AS nth FROM boxes WHERE box % 4 <> 3"


def _crop_ids(i):
    box = F.struct("x", "y", "w", "h")
    entries = i.boxes.selectExpr("page * 10 + box AS entry", "CASE WHEN box % 5 = 0 THEN concat('own', page) WHEN box % 5 = 1 THEN ' ' END AS crop_id", "page", "box % 3 AS step", "x", "y", "w", "h", "CASE WHEN box % 2 = 0 THEN box END AS crop_index")
    labels = i.boxes.filter("box % 4 <> 3").selectExpr("concat('lab', page, '_', box) AS crop_id", "page", "box % 3 AS step", "x + (box % 4) * 4 AS x", "y", "w", "h", "box AS nth")
    return a.resolve_crop_ids(entries.withColumn("box", box), labels.withColumn("box", box))


register(
    "j18_crop_id_resolve", _crop_ids,
    f"""WITH e AS (SELECT {_ENTRY}), l AS (SELECT {_LABEL}),
    m AS (SELECT e.entry, count(*) AS n, min(l.crop_id) AS sole, arg_min(l.crop_id, l.nth) FILTER (WHERE abs(e.x - l.x) <= 8 AND abs(e.y - l.y) <= 8 AND abs(e.w - l.w) <= 8 AND abs(e.h - l.h) <= 8) AS near FROM e JOIN l USING (page, step) GROUP BY 1)
    SELECT entry, CASE WHEN trim(e.crop_id) <> '' THEN trim(e.crop_id) WHEN n = 1 THEN sole WHEN near IS NOT NULL THEN near ELSE concat('p', page, '_s', step, '_c', coalesce(crop_index, 1)) END AS crop_id, CASE WHEN trim(e.crop_id) <> '' THEN 'own' WHEN n = 1 THEN 'sole_label' WHEN near IS NOT NULL THEN 'close_label' ELSE 'made' END AS rule FROM e LEFT JOIN m USING (entry)""",
)


def _misreads(i):
    rows = i.boxes.selectExpr("l_suppkey % 5 AS set_id", "page", "x % 97 AS value", "if(box % 3 = 0, 'qty_rejected_read', if(box % 3 = 1, 'step_probe', 'step_map')) AS source", "y % 90 AS parent", "box % 4 AS components", "box % 7 = 0 AS is_primary", "y % 150 AS step", "box")
    return a.classify_misreads(rows, rows.filter("box % 2 = 0").select("set_id", "page", "step"), rows.filter("box % 6 = 5"))


_VARIANTS = "variants AS (SELECT n, v FROM (SELECT n, try_cast(concat(t[:i - 1], CASE t[i] WHEN '7' THEN '2' WHEN '2' THEN '7' WHEN '8' THEN '3' WHEN '3' THEN '8' WHEN '5' THEN '6' WHEN '6' THEN '5' WHEN '1' THEN '7' WHEN '0' THEN '8' END, t[i + 1:]) AS INT) AS v, t[i] IN ('7', '2', '8', '3', '5', '6', '1', '0') AS ok FROM (SELECT n, CAST(n AS VARCHAR) AS t, unnest(range(1, length(CAST(n AS VARCHAR)) + 1)) AS i FROM (SELECT unnest(range(0, 150)) AS n))) WHERE ok)"
register(
    "w24_misread_classify", _misreads,
    f"""WITH {_VARIANTS}, d AS (SELECT l_suppkey % 5 AS set_id, page, x % 97 AS value, CASE box % 3 WHEN 0 THEN 'qty_rejected_read' WHEN 1 THEN 'step_probe' ELSE 'step_map' END AS source, y % 90 AS parent, box % 4 AS components, box % 7 = 0 AS is_primary, y % 150 AS step, box FROM boxes),
    v AS (SELECT DISTINCT set_id, page, step FROM d WHERE box % 2 = 0), n AS (SELECT set_id, page, count(*) AS steps, min(step) AS least FROM v GROUP BY ALL),
    r AS (SELECT d.* EXCLUDE (step), n.steps, n.least, d.value IN (1, 4, 7) AND (components <= 1 OR source = 'step_probe') AND NOT is_primary AND least >= 20 AS probe FROM d JOIN n USING (set_id, page) WHERE NOT EXISTS (SELECT 1 FROM d AS k WHERE k.box % 6 = 5 AND k.set_id = d.set_id AND k.page = d.page AND k.value = d.value) AND NOT EXISTS (SELECT 1 FROM v WHERE v.set_id = d.set_id AND v.page = d.page AND v.step = d.value)),
    c AS (SELECT r.*, v.step, starts_with(CAST(v.step AS VARCHAR), CAST(r.value AS VARCHAR)) AS prefix, bool_or(starts_with(CAST(v.step AS VARCHAR), CAST(r.value AS VARCHAR))) OVER (PARTITION BY r.set_id, r.page, r.box) AS begun FROM r JOIN v USING (set_id, page)),
    o AS (SELECT *, unnest([CASE WHEN source = 'qty_rejected_read' AND parent = step THEN {{'score': 0.99, 'nth': 0, 'rule': 'rejected_read_of_valid_anchor'}} END, CASE WHEN prefix AND length(CAST(value AS VARCHAR)) < length(CAST(step AS VARCHAR)) THEN {{'score': 0.95, 'nth': 1, 'rule': 'prefix_fragment_of_valid_step'}} END,
        CASE WHEN EXISTS (SELECT 1 FROM variants w WHERE (w.n = c.step AND w.v = c.value) OR (w.n = c.value AND w.v = c.step)) AND abs(step - value) <= 100 THEN {{'score': 0.92, 'nth': 2, 'rule': 'digit_swap_variant_of_valid_step'}} END, CASE WHEN probe AND steps = 1 THEN {{'score': 0.88, 'nth': 3, 'rule': 'spurious_probe_digit_single_valid_step'}} END,
        CASE WHEN probe AND steps > 1 AND begun AND prefix THEN {{'score': 0.90, 'nth': 4, 'rule': 'prefix_fragment_of_valid_step'}} END, CASE WHEN probe AND steps > 1 AND NOT begun AND step = least THEN {{'score': 0.85, 'nth': 5, 'rule': 'spurious_probe_digit_on_multi_step_page'}} END]) AS q FROM c),
    b AS (SELECT * FROM o WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY set_id, page, box ORDER BY q.score DESC, abs(step - value), step, q.nth) = 1)
    SELECT set_id, page, value, step AS corrected, arg_min(q.rule, (-q.score, q.nth)) AS rule, max(q.score)::DOUBLE AS score FROM b GROUP BY ALL""",
)


def _gap_tables(i):
    v = i.page_steps.selectExpr("set_id", "page", "cast(value div 30 as int) AS value")
    gaps = i.manual.select("set_id", F.explode(F.expr("sequence(0, 9)")).alias("value")).selectExpr("*", "value * 7 AS gap_page", "value % 4 = 0 AS anchor")
    return gaps, v.filter("page % 5 = 0"), v.filter("page % 10 = 0 or page % 7 = 0"), v.filter("page % 9 = 0"), v.filter("page % 4 = 1").withColumn("audit_only", F.expr("page % 8 = 1")), v.filter("page % 6 = 0")


_GAP = """v AS (SELECT set_id, page, CAST(value // 30 AS INT) AS value FROM page_steps), g AS (SELECT set_id, unnest(range(0, 10))::INT AS value FROM manual),
    n AS (SELECT set_id, value, min(page) AS new_page, bool_or(page % 8 = 1) AS audit FROM v WHERE page % 4 = 1 GROUP BY ALL),
    f AS (SELECT g.set_id, g.value, g.value * 7 AS gap_page, g.value % 4 = 0 AS anchor, (g.set_id, g.value) IN (SELECT (set_id, value) FROM v WHERE page % 5 = 0) AS label, (g.set_id, g.value) IN (SELECT (set_id, value) FROM v WHERE page % 10 = 0 OR page % 7 = 0) AS cached, (g.set_id, g.value) IN (SELECT (set_id, value) FROM v WHERE page % 9 = 0) AS old, n.value IS NOT NULL AS new, new_page, coalesce(audit, false) AS audit, (g.set_id, g.value) IN (SELECT (set_id, value) FROM v WHERE page % 6 = 0) AS callout FROM g LEFT JOIN n USING (set_id, value)),
    gp AS (SELECT set_id, value, CASE WHEN label AND cached THEN 'PARITY_MATCH' WHEN label OR (new AND callout AND NOT cached) THEN 'V2_FAILURE' WHEN NOT (old OR new OR anchor) THEN 'FALSE_STEP' WHEN (value = 8 AND gap_page IS DISTINCT FROM new_page) OR (new AND NOT old AND audit) THEN 'V2_FAILURE' WHEN NOT callout THEN 'EMPTY_STEP' ELSE 'V1_TRUTH_INCOMPLETE' END AS class,
        array_to_string(list_filter([CASE WHEN NOT label THEN 'label' END, CASE WHEN NOT cached THEN 'cached' END, CASE WHEN NOT old THEN 'old' END, CASE WHEN NOT new THEN 'new' END, CASE WHEN NOT callout THEN 'callout' END, CASE WHEN NOT anchor THEN 'anchor' END], lambda c: c IS NOT NULL), ',') AS lacks FROM f)"""
register("j23_gap_parity", lambda i: a.gap_parity(*_gap_tables(i), same_page=(8,)), f"WITH {_GAP} SELECT * FROM gp")
register("a11_gap_class_counts", lambda i: p.class_counts(a.gap_parity(*_gap_tables(i), same_page=(8,))), f"WITH {_GAP} SELECT class, count(*) AS n FROM gp GROUP BY 1")


def _sections(i):
    """Both runs are of the same boxes, so each box is one row of facts with all its roles, and another as a false step."""
    b = cut(i.boxes.select("page", "box", "x", "y", "h")).selectExpr("page AS set_id", "box % 2 AS bag", "concat('c', box) AS crop_id", "box AS value", "x", "y", "h")
    sections = b.groupBy("set_id", "bag").agg(F.min("x").alias("start_page"), F.max("x").alias("end_page"))
    found = sections.withColumn("start_page", F.expr("start_page + if(set_id % 5 = 0, 1, 0)"))
    roles = {"old_id": "y % 3 = 0", "new_id": "x % 11 <> 0", "expected": "true", "present": "y % 29 <> 0", "label": "value % 3 = 0", "visible": "y % 4 = 0", "old_qty": "value % 4 <> 0", "new_qty": "true"}
    each = b.withColumns({"old_qty": F.col("h"), "new_qty": F.expr("h + if(x % 23 = 0, 1, 0)")})
    facts = a.role_facts(each, {role: F.expr(when) for role, when in roles.items()})
    false_steps = a.role_facts(b.filter("y % 31 = 0").withColumn("value", F.col("value") + 100), {"present": F.lit(True)})
    return a.section_parity_of(sections, found, facts.unionByName(false_steps))


register(
    "q07_section_parity", _sections,
    """WITH b AS (SELECT page AS set_id, box % 2 AS bag, box AS value, x, y FROM boxes),
    k AS (SELECT set_id, bag, set_id % 5 <> 0 AS range_holds, count(*) FILTER (WHERE y % 3 = 0 AND x % 11 = 0) AS missing_ids, count(*) FILTER (WHERE y % 29 = 0) AS missing_steps, count(*) FILTER (WHERE y % 31 = 0) AS false_steps, count(*) FILTER (WHERE value % 3 = 0 AND x % 11 = 0) AS unresolved, count(*) FILTER (WHERE y % 4 = 0 AND x % 11 = 0) AS missing_crops, count(*) FILTER (WHERE value % 4 <> 0 AND x % 23 = 0) AS qty_mismatch FROM b GROUP BY ALL)
    SELECT *, missing_steps + false_steps = 0 AS exact_steps, range_holds AND missing_ids + missing_steps + false_steps + unresolved + missing_crops + qty_mismatch = 0 AS passes FROM k""",
)

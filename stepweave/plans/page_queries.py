"""Queries of page rules, audits and gates."""

from __future__ import annotations

from stepweave.operators import pages as p, sequences as q
from stepweave.plans.base import register
from stepweave.plans.sequence_queries import _WINDOWS

F = p.F
_SIG = "sig AS (SELECT doc_id, CAST(doc_id % 9 AS INT) AS page, CAST(n_chars % 60 AS INT) AS words, CAST(n_chars % 13 AS INT) AS lines, CAST(n_chars % 17 AS INT) AS long_words, CAST(n_chars % 31 AS INT) AS numbers, CAST(doc_id % 10 AS INT) AS boxes, (n_chars % 11 / 11.0)::DOUBLE AS bright, (doc_id % 10 / 50.0)::DOUBLE AS edges, (n_chars % 7 / 10.0)::DOUBLE AS largest_box FROM documents)"


def _sig(i):
    return i.documents.selectExpr("doc_id", "cast(doc_id % 9 as int) as page", "cast(n_chars % 60 as int) as words", "cast(n_chars % 13 as int) as lines", "cast(n_chars % 17 as int) as long_words", "cast(n_chars % 31 as int) as numbers", "cast(doc_id % 10 as int) as boxes", "n_chars % 11 / 11.0D as bright", "doc_id % 10 / 50.0D as edges", "n_chars % 7 / 10.0D as largest_box")


_KIND = "kinds AS (SELECT doc_id, page, CASE WHEN page <= 2 AND words <= 20 AND lines <= 8 AND bright < 0.30::DOUBLE AND edges >= 0.06::DOUBLE THEN 'cover_page' WHEN (words >= 35 OR lines >= 9 OR (words >= 24 AND lines >= 6) OR (words >= 22 AND long_words >= 12)) AND largest_box < 0.35::DOUBLE THEN 'intro_or_legal' WHEN (numbers >= 20 OR (numbers >= 12 AND boxes >= 8) OR (numbers >= 10 AND lines >= 10 AND boxes >= 6)) AND largest_box < 0.20::DOUBLE THEN 'parts_page' ELSE 'other' END AS kind FROM sig)"
register("p03_page_kind", lambda i: p.page_kind(_sig(i)).select("doc_id", "page", "kind"), f"WITH {_SIG}, {_KIND} SELECT * FROM kinds")
register("p20_page_kind_scan", lambda i: p.page_kind_scan(_sig(i)).select("doc_id", "page"), f"WITH {_SIG}, {_KIND} SELECT doc_id, page FROM kinds WHERE kind = 'other'")
_EV = "ev AS (SELECT set_id, page, CASE WHEN value % 4 > 0 THEN value % 13 END AS detected, value % 2 = 0 AS number, page % 2 = 0 AS panel, page % 3 = 0 AS shell, value % 3 <> 0 AS grey, page % 11 = 0 AS overview, (value % 20 / 20.0)::DOUBLE AS confidence, CASE WHEN page % 13 = 0 THEN 'parts_page' ELSE 'other' END AS kind, page % 6 AS green FROM page_steps), e AS (SELECT *, panel AND shell AND grey AS strong FROM ev)"


def _ev(i):
    rows = i.page_steps.selectExpr("set_id", "page", "case when value % 4 > 0 then value % 13 end as detected", "value % 2 = 0 as number", "if(page % 2 = 0, true, null) as panel", "page % 3 = 0 as shell", "value % 3 <> 0 as grey", "page % 11 = 0 as overview", "value % 20 / 20.0D as confidence", "if(page % 13 = 0, 'parts_page', 'other') as kind", "page % 6 as green")
    return p.normalize_page_row(rows)


register("p02_normalize_page_row", lambda i: _ev(i), f"WITH {_EV} SELECT * FROM e")
register("p04_shortlist", lambda i: p.shortlist(_ev(i).withColumnRenamed("detected", "bag")).select("set_id", "page", "confidence"), f"WITH {_EV} SELECT set_id, page, confidence FROM e WHERE confidence >= 0.5 AND (number OR grey) AND (detected IS NOT NULL OR confidence >= 0.6::DOUBLE OR (panel AND number)) ORDER BY confidence DESC, set_id, page LIMIT 40")
register("p05_strong_candidates", lambda i: p.strong_candidates(_ev(i).withColumnRenamed("detected", "bag")).select("set_id", "page", "bag"), f"WITH {_EV} SELECT set_id, page, detected AS bag FROM e WHERE grey AND number AND confidence >= 0.85::DOUBLE AND detected > 0")
register("t02_scan_order", lambda i: p.scan_order(_ev(i).withColumnRenamed("detected", "bag")).select("set_id", "page", "bag"), f"WITH {_EV} SELECT set_id, page, detected AS bag FROM e ORDER BY strong DESC, number DESC, grey DESC, panel DESC, confidence DESC, detected NULLS LAST, set_id, page")
_SCORE = """round_even(CASE WHEN number THEN 40.0 ELSE -16.0 END + CASE WHEN detected = bag THEN CASE WHEN weak THEN 12.0 ELSE 85.0 END WHEN detected IS NULL THEN -10.0 ELSE -25.0 - least(30.0, abs(detected - bag) * 8.0) END + CASE WHEN panel THEN 18.0 ELSE -8.0 END + CASE WHEN shell THEN 10.0 ELSE 0.0 END + CASE WHEN grey THEN 12.0 ELSE 0.0 END
    + CASE WHEN strong THEN 12.0 ELSE -12.0 END + CASE WHEN confidence <= 0.30::DOUBLE THEN -14.0 ELSE 0.0 END + CASE WHEN early <= 0.20::DOUBLE THEN -8.0 ELSE 0.0 END + CASE WHEN overview THEN -22.0 ELSE 0.0 END + CASE WHEN kind <> 'other' THEN -18.0 ELSE 0.0 END + CASE WHEN weak THEN -150.0 ELSE 0.0 END + CASE WHEN green >= 4 THEN -90.0 WHEN green >= 2 THEN -55.0 ELSE 0.0 END
    + CASE WHEN kind = 'other' AND NOT number AND NOT strong AND detected IS NULL THEN -15.0 ELSE 0.0 END + confidence * 35.0 + early * 14.0 + 1e-9, 3)"""
_SCAN = f"""{_WINDOWS}, {_EV}, o AS (SELECT e.* FROM e ANTI JOIN truth t ON t.set_id = e.set_id AND t.page = e.page), i AS (SELECT w.bag, w.previous_page, w.next_page, o.* FROM w JOIN o ON o.set_id = w.set_id AND o.page > w.previous_page AND o.page < w.next_page WHERE w.next_page - w.previous_page >= 2),
    x AS (SELECT *, number AND NOT strong AND NOT shell AND NOT grey AS weak, 1.0::DOUBLE - (page - previous_page - 1)::DOUBLE / greatest(1, next_page - previous_page - 2) AS early FROM i), s AS (SELECT *, ({_SCORE})::DOUBLE AS score FROM x)"""


def _scan(i):
    return p.gap_window_scan(q.missing_windows(i.truth).select("set_id", "bag", "previous_page", "next_page"), _ev(i), i.truth)


register("f08_window_score", lambda i: _scan(i).select("set_id", "bag", "page", "score"), f"WITH {_SCAN} SELECT set_id, bag, page, score FROM s")
register("j22_gap_window_scan", lambda i: _scan(i).filter("top").select("set_id", "bag", "page"), f"WITH {_SCAN} SELECT set_id, bag, page FROM s QUALIFY row_number() OVER (PARTITION BY set_id, bag ORDER BY CASE WHEN detected = bag THEN 0 WHEN detected IS NOT NULL THEN 1 ELSE 2 END, score DESC, page) = 1")
register("j09_page_in_range", lambda i: p.page_in_range(i.page_steps, i.starts), "SELECT p.set_id, p.page, max(s.bag) AS bag FROM page_steps p JOIN starts s ON s.set_id = p.set_id AND s.page <= p.page GROUP BY ALL")
register("p10_page_range_expand", lambda i: p.page_range_expand(i.manual.select(F.col("set_id").alias("key"), F.expr("concat(set_id % 7, ',', last_page, '-', set_id % 90, ', x')").alias("text"))), "SELECT DISTINCT set_id AS key, page FROM (SELECT set_id, unnest([(set_id % 7)::INT] || range(least(last_page, (set_id % 90)::INT), greatest(last_page, (set_id % 90)::INT) + 1)::INT[]) AS page FROM manual)")
register("p21_front_matter", lambda i: p.front_matter(q.gap_clusters(i.starts)).groupBy("evidence_only").count().withColumnRenamed("count", "n"), "WITH f AS (SELECT set_id, page, CASE WHEN page - lag(page) OVER (PARTITION BY set_id ORDER BY page) <= 6 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT set_id, page FROM starts)), c AS (SELECT set_id, page, sum(fresh) OVER (PARTITION BY set_id ORDER BY page) AS k FROM f), m AS (SELECT set_id, k, min(page) AS s FROM c GROUP BY ALL) SELECT s <= 5 AS evidence_only, count(*) AS n FROM m GROUP BY 1")
_ROLES = "pr AS (SELECT set_id, page, value, lag(value) OVER (PARTITION BY set_id ORDER BY page) AS pm FROM page_steps), ro AS (SELECT *, CASE WHEN pm >= 20 AND pm - value >= 10 AND value <= 3 THEN 'step_sequence_reset' WHEN value >= pm THEN 'build_step_sequence_page' ELSE 'ambiguous' END AS role, coalesce(pm >= 20 AND pm - value >= 10 AND value <= 9, false) AS hero FROM pr)"
register("p19_verify_prefilter", lambda i: p.verify_prefilter(q.step_roles(i.page_steps)).select("set_id", "page", "skip_reason"), f"WITH {_ROLES} SELECT set_id, page, CASE WHEN page <= 3 THEN 'front page' WHEN pm IS NULL THEN 'no previous steps' WHEN pm < 10 THEN 'previous max below 10' WHEN value <> 1 THEN 'no step 1' WHEN pm - value < 10 THEN 'drop below 10' END AS skip_reason FROM ro")
register("p18_transition_role", lambda i: p.transition_role(q.step_roles(i.page_steps), F.col("page") % 2 == 0).select("set_id", "page", "role"), f"WITH {_ROLES} SELECT set_id, page, CASE WHEN hero AND role <> 'step_sequence_reset' AND page % 2 = 0 THEN 'hero_transition_reset' ELSE role END AS role FROM ro")
register("p14_clean_gate", lambda i: i.bundles.select("doc_id", p.clean_gate(F.col("status"), F.expr("if(doc_id % 2 = 0, 'accepted', null)")).alias("gate")), "SELECT doc_id, CASE WHEN status = 'rejected' THEN 'not_clean' WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'not_accepted' END AS gate FROM bundles")
register("p15_accept_gate", lambda i: i.bundles.select("doc_id", p.accept_gate(F.expr("doc_id % 2 = 0"), F.expr("if(doc_id % 3 = 0, 'clean', status)"), F.expr("if(doc_id % 5 = 0, 'p', '')")).alias("ok")), "SELECT doc_id, doc_id % 2 <> 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS ok FROM bundles")
_SLOTS = "slots AS (SELECT doc_id AS slot, concat('page/', doc_id % 40, '.png') AS page_path, CASE WHEN doc_id % 3 = 0 THEN concat('cache/', doc_id, '.png') ELSE concat('crop/', doc_id % 90, '.jpg') END AS crop_path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('cut/', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.png' END) END AS cutout_path FROM bundles)"
register("k04_asset_plan", lambda i: p.asset_plan(i.bundles.selectExpr("doc_id as slot", "concat('page/', doc_id % 40, '.png') as page_path", "if(doc_id % 3 = 0, concat('cache/', doc_id, '.png'), concat('crop/', doc_id % 90, '.jpg')) as crop_path", "if(doc_id % 4 = 0, null, concat('cut/', doc_id, if(doc_id % 5 = 0, '.txt', '.png'))) as cutout_path")), f"WITH {_SLOTS}, u AS (SELECT slot, 'page_path' AS role, page_path AS path FROM slots UNION ALL SELECT slot, 'crop_path', crop_path FROM slots UNION ALL SELECT slot, 'cutout_path', cutout_path FROM slots), f AS (SELECT * FROM u WHERE path IS NOT NULL AND NOT starts_with(path, 'cache/') AND NOT ends_with(path, '.txt')) SELECT slot, role, path, concat('assets/', role, '/', regexp_extract(path, '[^/]+$')) AS target FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY slot, role) = 1")


def _parity(i):
    v = i.page_steps.select("set_id", "page", F.expr("cast(value div 30 as int)").alias("value"))
    expected = i.manual.select("set_id", F.explode(F.expr("sequence(0, 9)")).alias("value")).withColumn("expected", F.lit(True))
    return p.parity(expected, v.filter("page % 3 <> 0"), v.filter("page % 2 = 0"))


_PAR = "v AS (SELECT set_id, page, value // 30 AS value FROM page_steps), x AS (SELECT set_id, unnest(range(0, 10))::INT AS value, true AS expected FROM manual), o AS (SELECT DISTINCT set_id, value, true AS old FROM v WHERE page % 3 <> 0), n AS (SELECT DISTINCT set_id, value, true AS new FROM v WHERE page % 2 = 0), j AS (SELECT set_id, value, coalesce(expected, false) AS expected, coalesce(old, false) AS old, coalesce(new, false) AS new FROM x FULL JOIN o USING (set_id, value) FULL JOIN n USING (set_id, value)), par AS (SELECT *, CASE WHEN expected AND old AND new THEN 'PARITY_MATCH' WHEN expected AND old THEN 'V2_FAILURE' WHEN NOT expected AND new THEN 'FALSE_STEP' WHEN expected AND NOT old AND NOT new THEN 'EMPTY_STEP' ELSE 'V1_TRUTH_INCOMPLETE' END AS class FROM j)"
register("j23_parity", _parity, f"WITH {_PAR} SELECT * FROM par")
register("a11_class_counts", lambda i: p.class_counts(_parity(i)), f"WITH {_PAR} SELECT class, count(*) AS n FROM par GROUP BY 1")
register("q07_parity_gate", lambda i: p.parity_gate(_parity(i)), f"WITH {_PAR} SELECT set_id, count(*) FILTER (WHERE class = 'V2_FAILURE') AS missing, count(*) FILTER (WHERE class = 'FALSE_STEP') AS false_steps, bool_and(class = 'PARITY_MATCH') AS passes FROM par GROUP BY 1")
register("q01_required_fields", lambda i: p.required_fields(i.bundles.withColumn("source", F.expr("if(doc_id % 4 = 0, ' ', source)")), ["doc_id"], ["status", "source"]), "SELECT doc_id, 'status' AS field FROM bundles WHERE status IS NULL UNION ALL SELECT doc_id, 'source' FROM bundles WHERE doc_id % 4 = 0")
register("q02_nonzero_count", lambda i: p.nonzero_count(i.documents.select(F.expr("doc_id % 700").alias("conv_id"), F.expr("doc_id % 3").alias("declared")).distinct(), i.conversations, "conv_id"), "WITH d AS (SELECT DISTINCT doc_id % 700 AS conv_id, doc_id % 3 AS declared FROM documents), n AS (SELECT conv_id, count(*) AS listed FROM conversations GROUP BY 1) SELECT conv_id, declared, coalesce(listed, 0) AS listed FROM d LEFT JOIN n USING (conv_id) WHERE declared <= 0 OR listed IS NULL")
register("q03_path_referential", lambda i: p.path_referential(i.documents.select("doc_id", F.expr("concat(if(doc_id % 50 = 0, '../', 'd/'), doc_id)").alias("path")), i.labels.select(F.expr("concat('d/', doc_id)").alias("path"))), "SELECT doc_id, concat(CASE WHEN doc_id % 50 = 0 THEN '../' ELSE 'd/' END, doc_id) AS path FROM documents WHERE doc_id % 50 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)")
register("q04_stage_order", lambda i: p.stage_order(i.conversations.filter("turn % 3 <> 1").select("conv_id", F.col("turn").alias("stage")), "conv_id"), "WITH s AS (SELECT conv_id, turn AS stage FROM conversations WHERE turn % 3 <> 1), t AS (SELECT conv_id, unnest(range(0, max(stage) + 1)) AS stage FROM s GROUP BY conv_id) SELECT conv_id, stage FROM t ANTI JOIN s USING (conv_id, stage)")
register("q05_path_parity", lambda i: p.path_parity(i.documents.filter("doc_id % 3 <> 0").select("doc_id", F.expr("concat('p', doc_id)").alias("path")), i.documents.filter("doc_id % 2 = 0").select("doc_id", F.expr("concat('p', doc_id - doc_id % 4)").alias("path")), "doc_id"), "WITH o AS (SELECT doc_id, concat('p', doc_id) AS old_path FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, concat('p', doc_id - doc_id % 4) AS new_path FROM documents WHERE doc_id % 2 = 0) SELECT *, old_path IS NOT DISTINCT FROM new_path AS same FROM o FULL JOIN n USING (doc_id)")
register("q06_id_presence", lambda i: p.id_presence(i.bundles.withColumn("bundle_id", F.expr("if(doc_id % 9 = 0, '', bundle_id)")), "bundle_id"), "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 9 = 0) AS without_id FROM bundles")
register("p13_asset_filter", lambda i: i.pages.selectExpr("page_id", "concat(if(page_id % 3 = 0, 'cache/', 'run/'), if(page_id % 5 = 0, 'debug_', ''), page_id, if(page_id % 2 = 0, '.PNG', '.txt')) as path").select("page_id", p.asset_filter(F.col("path")).alias("asset")), "SELECT page_id, page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 AS asset FROM pages")

"""Queries of the review process."""

from __future__ import annotations

from stepweave.operators import audits as a, state as m
from stepweave.plans.base import register

F = a.F
register("p12_review_queue", lambda i: a.review_queue(i.bundles.selectExpr("doc_id as bundle_id", "status", "source", "doc_id % 17 as created_at"), "pending", limit=700).select("bundle_id", "created_at"), "SELECT doc_id AS bundle_id, doc_id % 17 AS created_at FROM bundles WHERE coalesce(status, 'pending') = 'pending' ORDER BY created_at, bundle_id LIMIT 500")
register("p09_trusted_anchor_guard", lambda i: a.trusted_anchor_guard(i.multi_steps.filter("h % 2 = 0").select("set_id", "page", "value"), i.multi_steps.filter("h % 3 = 0")), "WITH k AS (SELECT set_id, page, list(DISTINCT value) AS known FROM multi_steps WHERE h % 3 = 0 GROUP BY ALL) SELECT v.set_id, v.page, CASE WHEN known IS NULL THEN v.value END AS value, CASE WHEN known IS NULL THEN NULL WHEN list_contains(known, v.value) THEN 'duplicate' ELSE 'non_sequential' END AS reason FROM multi_steps v LEFT JOIN k USING (set_id, page) WHERE v.h % 2 = 0")
register("p22_crop_required", lambda i: i.bundles.select("doc_id", a.crop_required(F.expr("case doc_id % 4 when 0 then 'FALSE_STEP' when 1 then 'PART' end"), F.expr("doc_id % 3 > 0"), F.expr("doc_id % 5 = 0")).alias("needed")), "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN false WHEN doc_id % 4 = 1 THEN true ELSE doc_id % 5 = 0 END AS needed FROM bundles")
register("p23_good_label_queries", lambda i: a.good_label_queries(i.bundles.select(F.col("doc_id").alias("crop"), F.expr("if(doc_id % 2 = 0, 'good', 'bad') as status"), F.expr("if(doc_id % 3 = 0, array(), array(source, 'x')) as parts"))), "SELECT doc_id AS crop, source AS expected FROM bundles WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")


def _items(i):
    return i.documents.select(F.col("doc_id").alias("item"), "source")


def _masks(i):
    return i.documents.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("item"))


def _verdicts(i):
    return i.labels.select(F.col("doc_id").alias("item"), F.expr("if(toxic = 1, 'fail', 'pass')").alias("verdict"))


_WORK = "work AS (SELECT d.doc_id AS item, d.source, CASE WHEN d.doc_id % 7 = 0 THEN 'no mask' WHEN l.doc_id IS NULL THEN 'no verdict' WHEN l.toxic = 1 THEN 'failed' END AS why, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
register("j07_mask_worklist", lambda i: a.mask_worklist(_items(i), _masks(i), _verdicts(i)), f"WITH {_WORK} SELECT item, why FROM work WHERE why IS NOT NULL")
register("a13_review_counts", lambda i: a.review_counts(_items(i), _verdicts(i)), f"WITH {_WORK} SELECT count(*) AS total, count(toxic) AS reviewed, count(*) FILTER (WHERE toxic = 0) AS passed, count(*) FILTER (WHERE toxic = 1) AS failed FROM work")
register("a20_phase", lambda i: a.phase(_items(i), _masks(i), _verdicts(i), "source"), f"WITH {_WORK} SELECT source, CASE WHEN bool_or(why = 'no mask') THEN 'generate_masks' WHEN bool_or(why = 'no verdict') THEN 'review_pending' WHEN bool_or(why = 'failed') THEN 'review_required' ELSE 'ready_to_commit' END AS phase FROM work GROUP BY source")
register("j08_rejected_only", lambda i: a.rejected_only(i.examples.select("part_num", "qty", "event_id"), i.examples.filter("event_id % 2 = 0"), ["part_num", "qty"]), "SELECT e.part_num, e.qty, e.event_id FROM examples e WHERE NOT EXISTS (SELECT 1 FROM examples x WHERE x.event_id % 2 = 0 AND x.part_num IS NOT DISTINCT FROM e.part_num AND x.qty IS NOT DISTINCT FROM e.qty)")
register(
    "j17_multi_key_resolve",
    lambda i: a.multi_key_resolve(i.boxes.filter("box % 2 = 1").selectExpr("concat('p', page, '_', box) as crop_id", "page", "box % 3 as step", "x", "y"), i.boxes.filter("box % 2 = 0").selectExpr("box as entry", "concat('p', page, '_', box - 1) as crop_id", "page", "box % 3 as step", "x", "y").filter("x % 3 > 0")),
    """WITH c AS (SELECT concat('p', page, '_', box) AS crop_id, page, box % 3 AS step, x, y FROM boxes WHERE box % 2 = 1), e AS (SELECT box AS entry, concat('p', page, '_', box - 1) AS crop_id, page, box % 3 AS step, x, y, count(*) OVER (PARTITION BY page, box % 3) = 1 AS alone FROM boxes WHERE box % 2 = 0 AND x % 3 > 0),
    r AS (SELECT c.crop_id, e.entry, 1 AS rule FROM c JOIN e USING (crop_id) UNION ALL SELECT c.crop_id, e.entry, CASE WHEN alone THEN 2 WHEN abs(c.x - e.x) <= 8 AND abs(c.y - e.y) <= 8 THEN 3 ELSE 4 END FROM c JOIN e ON c.page = e.page AND c.step = e.step), b AS (SELECT crop_id, entry, rule FROM r QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY rule, entry) = 1)
    SELECT c.crop_id, b.entry, coalesce(b.rule, 0) AS rule FROM c LEFT JOIN b USING (crop_id)""",
)
register("j19_manual_override", lambda i: a.manual_override(i.bundles.select(F.col("doc_id").alias("key"), F.col("source").alias("label")), i.bundles.filter("doc_id % 11 = 0").select(F.col("doc_id").alias("key"), F.lit("forced").alias("force"))), "SELECT doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'forced' ELSE source END AS label, doc_id % 11 = 0 AS forced FROM bundles")
register("j20_backfill_outer", lambda i: a.backfill_outer(i.bundles.filter("doc_id % 2 = 0").selectExpr("doc_id as crop_id", "n_chars % 300 as page"), i.bundles.selectExpr("doc_id as crop_id", "n_chars % 300 as page"), 50, 200), "SELECT doc_id AS crop_id, n_chars % 300 AS page, CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE 'label' END AS source FROM bundles WHERE doc_id % 2 = 0 OR n_chars % 300 BETWEEN 50 AND 200")
register("j28_link_or_create", lambda i: a.link_or_create(i.page_steps, i.page_steps.filter("page % 3 = 0").withColumn("crop", F.expr("concat('c', page)"))), "SELECT set_id, page, value, CASE WHEN page % 3 = 0 THEN concat('c', page) END AS crop, CASE WHEN page % 3 = 0 THEN 'link' ELSE 'create' END AS action FROM page_steps")
register("j30_label_precedence", lambda i: a.label_precedence(i.bundles.select(F.col("doc_id").alias("key")), i.bundles.filter("doc_id % 5 = 0").selectExpr("doc_id as key", "'preset' as label"), i.bundles.filter("doc_id % 3 = 0").selectExpr("doc_id as key", "'human' as label"), i.bundles.filter("doc_id % 2 = 0").selectExpr("doc_id as key")), "SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'preset' WHEN doc_id % 3 = 0 THEN 'human' WHEN doc_id % 2 = 0 THEN NULL ELSE 'EMPTY_STEP' END AS label FROM bundles")
register("j31_valid_steps", lambda i: a.valid_steps(i.page_steps.filter("page % 4 = 0"), i.page_steps.withColumn("components", F.expr("page % 3")), i.page_steps.withColumn("value", F.col("value") + 1)), "SELECT set_id, page, CASE WHEN page % 4 = 0 OR page % 3 = 2 THEN value ELSE value + 1 END AS value, CASE WHEN page % 4 = 0 THEN 1 WHEN page % 3 = 2 THEN 2 ELSE 3 END AS rank FROM page_steps")
register("a08_cluster_confidence", lambda i: a.cluster_confidence(i.multi_steps.select("set_id", F.expr("page % 50 as cluster"), "score")), "SELECT set_id, page % 50 AS cluster, round_even(CASE WHEN count(*) >= 2 THEN least(1.0, avg(score) + 0.05) ELSE avg(score) END + 1e-9, 4) AS confidence FROM multi_steps GROUP BY ALL")
_SUP = "(SELECT set_id, page, value FROM page_steps WHERE page % 5 = 0)"
register("a19_review_surface", lambda i: a.review_surface(i.page_steps.filter("page % 2 = 0"), i.page_steps.filter("page % 3 = 0"), i.page_steps.filter("page % 7 = 0"), i.page_steps.filter("page % 5 = 0").select("set_id", "page", "value")), "SELECT kind, count(*) AS n FROM (SELECT 'detected' AS kind, page FROM page_steps WHERE page % 2 = 0 UNION ALL SELECT 'completeness', page FROM page_steps WHERE page % 3 = 0 UNION ALL SELECT 'gap', page FROM page_steps WHERE page % 7 = 0) WHERE page % 5 <> 0 GROUP BY kind")
register("t01_fuzzy_rank", lambda i: a.fuzzy_rank(i.page_steps.selectExpr("set_id", "page", "cast(value % 60 as double) as score", "page % 9 = 0 as excluded")))
register("t04_audit_sample", lambda i: a.audit_sample(i.bundles.select("doc_id", "n_chars"), "doc_id", "n_chars"))
register("u01_detection_union", lambda i: a.detection_union(primary=i.page_steps.filter("page % 2 = 0"), audit=i.page_steps.filter("page % 3 = 0")), "SELECT set_id, page, value, 'primary' AS source FROM page_steps WHERE page % 2 = 0 UNION ALL SELECT set_id, page, value, 'audit' FROM page_steps WHERE page % 3 = 0")
register("u02_merge_sources", lambda i: a.merge_sources(a.detection_union(primary=i.page_steps.filter("page % 2 = 0"), audit=i.page_steps.filter("page % 3 = 0")), i.page_steps.filter("page % 5 = 0").select("set_id", "page", "value")), "SELECT set_id, page, value, list_sort(CASE WHEN page % 6 = 0 THEN ['audit', 'primary'] WHEN page % 2 = 0 THEN ['primary'] ELSE ['audit'] END) AS sources FROM page_steps WHERE (page % 2 = 0 OR page % 3 = 0) AND page % 5 <> 0")
register("u03_noise_except", lambda i: a.noise_except(i.multi_steps.select("set_id", "page", F.expr("h % 4 = 0").alias("passed"))), "SELECT set_id, page FROM multi_steps GROUP BY ALL HAVING NOT bool_or(h % 4 = 0)")
register("u04_suppressed_union", lambda i: a.suppressed_union(*(i.page_steps.filter(f"page % {k} = 0").select("set_id", "page") for k in (2, 3, 5))), "SELECT set_id, page FROM page_steps WHERE page % 2 = 0 OR page % 3 = 0 OR page % 5 = 0")
register("u05_candidate_distinct", lambda i: a.candidate_distinct(i.examples.select("part_num", "color_id", "qty", F.col("event_id").alias("ordinal"))), "SELECT part_num, color_id, event_id AS ordinal, qty FROM examples QUALIFY row_number() OVER (PARTITION BY part_num, color_id ORDER BY event_id) = 1")
register("f20_display_text", lambda i: m.label_event_fold(i.label_events).select("crop", "slot", a.display_text(F.col("label"), F.col("unknown"), F.col("ignored"), F.col("slot")).alias("text")), "WITH f AS (SELECT crop, slot, arg_max(label, seq) FILTER (WHERE kind = 'save') AS label, arg_max(kind, seq) AS last FROM label_events GROUP BY ALL) SELECT crop, slot, CASE WHEN last = 'ignored' THEN 'ignored' WHEN last = 'unknown' THEN 'unknown' WHEN label IS NOT NULL THEN concat(label, ' ', slot, 'x') ELSE 'open' END AS text FROM f")
register("f21_audit_paths", lambda i: i.bundles.select("doc_id", *(c.alias(n) for c, n in zip(a.audit_paths(F.expr("concat('crops/', bundle_id, '.png')")), ("overlay", "url")))), "SELECT doc_id, concat('crops/', bundle_id, '_overlay.png') AS overlay, concat('/images/', bundle_id, '.png') AS url FROM bundles")
register("w13_same_page_extension", lambda i: a.same_page_extension(i.multi_steps.filter("h % 2 = 0").withColumn("value", F.expr("cast((value + 1) / 2 as int)")), i.multi_steps.withColumn("value", F.expr("cast((value + 1) / 2 as int)"))), "WITH m AS (SELECT set_id, page, (value + 1) // 2 AS value, h FROM multi_steps), t AS (SELECT set_id, page, max(value) AS top FROM m WHERE h % 2 = 0 GROUP BY ALL), c AS (SELECT DISTINCT m.set_id, m.page, m.value, top FROM m JOIN t USING (set_id, page) WHERE m.value > top AND m.value <= top + 6), n AS (SELECT *, row_number() OVER (PARTITION BY set_id, page ORDER BY value) AS nth FROM c) SELECT set_id, page, value FROM n WHERE value - top = nth")
register("w26_bootstrap_start", lambda i: a.bootstrap_start(i.page_steps), "SELECT set_id, coalesce(min(CASE WHEN value = 1 THEN page END), min(page)) - 1 AS start FROM page_steps WHERE page > 5 GROUP BY set_id")
register("w27_priority_anchors", lambda i: a.priority_anchors(i.truth.filter("set_id % 2 = 0"), i.starts.filter("bag % 3 = 0").withColumn("page", F.expr("page + cast(set_id % 2 as int)")), i.starts.select("set_id", "page")), """WITH t AS (SELECT * FROM truth WHERE set_id % 2 = 0), c AS (SELECT set_id, bag, page + CAST(set_id % 2 AS INT) AS page FROM starts WHERE bag % 3 = 0), f AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.set_id = c.set_id AND (t.bag = c.bag OR t.page = c.page))),
    n AS (SELECT s.set_id, row_number() OVER (PARTITION BY s.set_id ORDER BY s.page) + coalesce((SELECT max(bag) FROM f WHERE f.set_id = s.set_id), 0) AS bag, s.page FROM starts s WHERE s.set_id NOT IN (SELECT set_id FROM t)) SELECT set_id, bag, page, 'truth' AS source FROM t UNION ALL SELECT set_id, bag, page, 'correction' FROM f UNION ALL SELECT set_id, bag, page, 'cluster' FROM n""")
register("p12_review_queue_of_a_set", lambda i: a.review_queue(i.bundles.selectExpr("doc_id as bundle_id", "status", "source", "doc_id % 17 as created_at", "cast(doc_id % 3 as string) as set_num", "doc_id % 2 as bag"), set_num="1", bag=1, limit=100).select("bundle_id", "created_at"), "SELECT doc_id AS bundle_id, doc_id % 17 AS created_at FROM bundles WHERE doc_id % 3 = 1 AND doc_id % 2 = 1 ORDER BY created_at, bundle_id LIMIT 100")
register("p22_callout_visibility", lambda i: i.bundles.select("doc_id", a.callout_visibility(F.expr("doc_id % 5 = 0"), F.expr("if(doc_id % 3 = 0, null, doc_id % 3 = 1)")).alias("visibility")), "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 1 THEN 'visible' WHEN doc_id % 3 = 2 THEN 'hidden' ELSE 'unknown' END AS visibility FROM bundles")
register("u05_candidate_elements", lambda i: a.candidate_distinct(i.examples.select("part_num", "color_id", (F.col("bundle") % 3).alias("element_id"), "qty", F.col("event_id").alias("ordinal"))), "SELECT part_num, color_id, bundle % 3 AS element_id, event_id AS ordinal, qty FROM examples QUALIFY row_number() OVER (PARTITION BY part_num, color_id, bundle % 3 ORDER BY event_id) = 1")

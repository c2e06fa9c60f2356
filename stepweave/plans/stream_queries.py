"""Batch twins of the streaming operators, and source projections over whole tables."""

from __future__ import annotations

from stepweave.operators import state as m
from stepweave.plans.base import register
from stepweave.sources import files
from stepweave.streaming import incremental as x

F = m.F
register("x05_windowed_rate", lambda i: x.windowed_rate(i.events), "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
register("x05_sliding_rate", lambda i: x.windowed_rate(i.events, "1 hour", "30 minutes"), "WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS start FROM events) SELECT start, event_type, count(*) AS n FROM s GROUP BY ALL")
register("x05_session_rate", lambda i: x.session_rate(i.events, "6 hours"), "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 hour THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
register("x06_memory_refresh", lambda i: x.memory_refresh(i.examples.select("event_id", F.col("part_num").alias("element_id")), i.vectors.select(F.col("vec_id").alias("element_id"), "label")), "SELECT event_id, part_num AS element_id, label FROM examples JOIN vectors ON vec_id = part_num")
register("s08_token_table", lambda i: files.token_table(i.boxes.select("text", F.col("x").alias("left"), F.col("y").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"), (F.col("score") * 1000 - 10).alias("conf")), 2.0), "SELECT text, round(x / 2.0)::INT AS x, round(y / 2.0)::INT AS y, round(w / 2.0)::INT AS w, round(h / 2.0)::INT AS h, greatest((score * 1000 - 10) / 100.0, 0.0) AS confidence FROM boxes")
register("s07_truth_import", lambda i: i.truth.withColumn("source", F.lit("imported")), "SELECT *, 'imported' AS source FROM truth")
register("s12_crop_cache_import", lambda i: files.crop_cache(i.bundles.select(F.expr("if(doc_id % 8 = 0, null, bundle_id)").alias("crop_id"), "doc_id")), "SELECT bundle_id AS crop_id, doc_id, CAST(doc_id % 3 AS INT) AS crop_index FROM bundles WHERE doc_id % 8 <> 0")


def _slots(i):
    fold = m.label_event_fold(i.label_events)
    return fold.withColumn("status", m.slot_status(F.col("label"), F.col("unknown"), F.col("ignored")))


register("k03_review_export", lambda i: files.review_export(_slots(i)).select("crop", "total", "open", F.size("slots").alias("records")), "WITH f AS (SELECT crop, slot, arg_max(label, seq) FILTER (WHERE kind = 'save') AS label, arg_max(kind, seq) AS last FROM label_events GROUP BY ALL) SELECT crop, count(*) AS total, count(*) FILTER (WHERE last NOT IN ('unknown', 'ignored') AND label IS NULL) AS open, count(*)::INT AS records FROM f GROUP BY crop")
register("k05_bundle_manifest", lambda i: files.bundle_manifest(i.bundles.select("bundle_id", "status", F.expr("map('page', concat('a/', doc_id, '.png'), 'mask', if(doc_id % 2 = 0, '', concat('m/', doc_id, '.png')))").alias("artifacts"), F.expr("array(concat('c/', doc_id, '_0.png'), null)").alias("cutouts"))), "WITH b AS (SELECT * FROM bundles WHERE status = 'approved'), r AS (SELECT bundle_id, 'page' AS role, concat('a/', doc_id, '.png') AS path FROM b UNION ALL SELECT bundle_id, 'mask', concat('m/', doc_id, '.png') FROM b WHERE doc_id % 2 <> 0 UNION ALL SELECT bundle_id, 'slot_cutout_0', concat('c/', doc_id, '_0.png') FROM b) SELECT bundle_id, role, path, concat('bundles/', bundle_id, '/', regexp_extract(path, '[^/]+$')) AS target FROM r")

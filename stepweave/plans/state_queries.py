"""Queries of the state operators."""

from __future__ import annotations

from stepweave.functions import scalars as f
from stepweave.operators import state as m
from stepweave.plans.base import register

F = m.F
_BATCH = "batch AS (SELECT set_id, bag, page + CAST(page % 3 = 0 AS INT) AS page, CAST(page AS BIGINT) * 10 AS ordinal FROM starts UNION ALL SELECT set_id, bag, page + 1 AS page, CAST(page AS BIGINT) * 10 + 5 AS ordinal FROM starts WHERE bag % 4 = 0)"


def _batch(i):
    one = i.starts.select("set_id", "bag", F.expr("page + cast(page % 3 = 0 as int) as page"), F.expr("cast(page as bigint) * 10 as ordinal"))
    return one.unionByName(i.starts.filter("bag % 4 = 0").select("set_id", "bag", F.expr("page + 1 as page"), F.expr("cast(page as bigint) * 10 + 5 as ordinal")))


_UPSERT = f"""{_BATCH}, j AS (SELECT b.*, t.page AS known, coalesce(t.page, first_value(b.page) OVER w) AS held, row_number() OVER w AS nth FROM batch b LEFT JOIN truth t ON t.set_id = b.set_id AND t.bag = b.bag WINDOW w AS (PARTITION BY b.set_id, b.bag ORDER BY b.ordinal)),
    o AS (SELECT ordinal, set_id, bag, page, CASE WHEN known IS NULL AND nth = 1 THEN 'inserted' WHEN held = page THEN 'exists' ELSE 'conflict' END AS status, held FROM j)"""
register("m01_truth_upsert", lambda i: m.truth_upsert(i.truth, _batch(i))[0], f"WITH {_UPSERT} SELECT ordinal, set_id, bag, page, status, CASE WHEN status = 'conflict' THEN held END AS existing_page FROM o")
register("m01_truth_after", lambda i: m.truth_upsert(i.truth, _batch(i))[1], f"WITH {_UPSERT} SELECT set_id, bag, page FROM truth UNION ALL SELECT set_id, bag, page FROM o WHERE status = 'inserted'")
_EX = "SELECT bundle, candidate_index, part_num, qty, event_id FROM examples"


def _ex(i, when):
    return i.examples.filter(when).select("bundle", "candidate_index", "part_num", "qty", "event_id")


register("m02_truth_replace", lambda i: m.replace_latest(_ex(i, "event_id % 2 = 0"), _ex(i, "event_id % 2 = 1"), ["bundle", "candidate_index"], "event_id", keep_missing=True), f"SELECT bundle, candidate_index, arg_max(part_num, event_id) AS part_num, arg_max(qty, event_id) FILTER (WHERE qty IS NOT NULL) AS qty, max(event_id) AS event_id FROM ({_EX}) GROUP BY ALL")
register("m06_example_upsert", lambda i: m.replace_latest(_ex(i, "event_id % 2 = 0"), _ex(i, "event_id % 2 = 1"), ["bundle", "candidate_index"], "event_id"), f"SELECT bundle, candidate_index, part_num, qty, event_id FROM ({_EX}) QUALIFY row_number() OVER (PARTITION BY bundle, candidate_index ORDER BY event_id DESC) = 1")
register(
    "m03_bundle_upsert",
    lambda i: m.bundle_upsert(i.bundles.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("bundle_id"), F.concat(F.lit("old/"), "doc_id").alias("path"), F.expr("if(doc_id % 5 = 0, '', status)").alias("status")), i.bundles.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("bundle_id"), F.concat(F.lit("new/"), "doc_id").alias("path"))),
    "SELECT doc_id AS bundle_id, CASE WHEN doc_id % 2 = 0 THEN concat('new/', doc_id) ELSE concat('old/', doc_id) END AS path, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'pending' ELSE coalesce(status, 'pending') END AS status FROM bundles WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
)
_REVIEWS = "reviews AS (SELECT doc_id * 2 AS bundle_id, CASE WHEN doc_id % 4 = 0 THEN 'unheard' ELSE 'approved' END AS new_status, CAST(doc_id % 7 AS INT) AS score, doc_id AS seq FROM bundles)"


def _reviews(i):
    return i.bundles.select((F.col("doc_id") * 2).alias("bundle_id"), F.expr("if(doc_id % 4 = 0, 'unheard', 'approved')").alias("new_status"), F.expr("cast(doc_id % 7 as int)").alias("score"), F.col("doc_id").alias("seq"))


def _index(i):
    return i.bundles.select(F.col("doc_id").alias("bundle_id"), "status")


_WHY = "CASE WHEN b.doc_id IS NULL THEN 'unknown bundle' WHEN new_status NOT IN ('approved','rejected','needs_split_fix','bad_mask','pending') THEN 'unknown status' WHEN NOT score BETWEEN 1 AND 5 THEN 'score out of range' END"
register("m04_review_update", lambda i: m.review_update(_index(i), _reviews(i))[0], f"WITH {_REVIEWS}, g AS (SELECT reviews.bundle_id, new_status, score FROM reviews LEFT JOIN bundles b ON b.doc_id = reviews.bundle_id WHERE {_WHY} IS NULL) SELECT b.doc_id AS bundle_id, coalesce(g.new_status, b.status) AS status, g.score FROM bundles b LEFT JOIN g ON g.bundle_id = b.doc_id")
register("m04_review_refused", lambda i: m.review_update(_index(i), _reviews(i))[1], f"WITH {_REVIEWS} SELECT reviews.bundle_id, new_status, score, {_WHY} AS why FROM reviews LEFT JOIN bundles b ON b.doc_id = reviews.bundle_id WHERE {_WHY} IS NOT NULL")
register("m05_id_backfill", lambda i: m.id_backfill(i.bundles.select("bundle_id", F.expr("cast(if(doc_id % 2 = 0, -1, null) as int)").alias("page"), F.lit(None).cast("string").alias("set_num")), f.bundle_fields(F.col("bundle_id")), ["page", "set_num"]), "SELECT bundle_id, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE CAST(n_chars % 300 AS INT) END AS page, CAST(70000 + doc_id % 50 AS VARCHAR) AS set_num FROM bundles")
register("m07_example_delete", lambda i: m.example_delete(i.bundles.select(F.col("bundle_id").alias("example_id")), i.bundles.filter("doc_id % 50 = 7").select(F.expr("concat(substring_index(bundle_id, '_', 1), '_bag1_')").alias("prefix"))), "SELECT bundle_id AS example_id FROM bundles WHERE NOT starts_with(bundle_id, '70007_bag1_')")
register("m07_example_delete_like", lambda i: m.example_delete(i.bundles.select(F.expr("concat(substring_index(bundle_id, '_', 1), '_bag', doc_id % 23, '_p', doc_id)").alias("example_id")), i.bundles.filter("doc_id % 50 = 7").select(F.expr("concat(substring_index(bundle_id, '_', 1), '_bag1_')").alias("prefix")), like_compat=True), "WITH e AS (SELECT concat(70000 + doc_id % 50, '_bag', doc_id % 23, '_p', doc_id) AS example_id FROM bundles) SELECT example_id FROM e WHERE example_id NOT LIKE '70007_bag1_%'")
_CAND = "[{{'index': {a}, 'status': 'open'}}, {{'index': {b}, 'status': 'accepted'}}]"
register(
    "m08_nested_update",
    lambda i: i.bundles.select("doc_id", F.expr("array(named_struct('index', cast(doc_id % 3 as int), 'status', 'open'), named_struct('index', cast(doc_id % 3 + 1 as int), 'status', 'accepted'))").alias("c")).select("doc_id", F.transform(m.nested_update("c", F.lit(1), F.lit("rejected")), lambda x: x["status"]).alias("statuses")),
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['open', 'rejected'] WHEN 1 THEN ['rejected', 'accepted'] ELSE ['open', 'rejected'] END AS statuses FROM bundles",
)
register(
    "m09_auto_promote",
    lambda i: i.bundles.select("doc_id", m.auto_promote(F.col("status"), F.expr("transform(sequence(0, cast(doc_id % 4 as int)), x -> named_struct('status', if(doc_id % 5 = x, 'open', 'accepted')))")).alias("status")),
    "SELECT doc_id, CASE WHEN status IN ('approved', 'rejected') THEN status WHEN doc_id % 5 > doc_id % 4 THEN 'approved' ELSE status END AS status FROM bundles",
)
_FOLD = "fold AS (SELECT crop, slot, arg_max(label, seq) FILTER (WHERE kind = 'save') AS label, arg_max(kind, seq) = 'unknown' AS unknown, arg_max(kind, seq) = 'ignored' AS ignored FROM label_events GROUP BY ALL)"


def _fold(i):
    return m.label_event_fold(i.label_events)


register("m10_label_event_fold", _fold, f"WITH {_FOLD} SELECT * FROM fold")
_STATUS = "CASE WHEN ignored THEN 'ignored' WHEN unknown THEN 'unknown' WHEN label IS NOT NULL THEN 'confirmed' ELSE 'needs_review' END"
register("p16_slot_status", lambda i: _fold(i).select("crop", "slot", m.slot_status(F.col("label"), F.col("unknown"), F.col("ignored")).alias("status")), f"WITH {_FOLD} SELECT crop, slot, {_STATUS} AS status FROM fold")
_PROGRESS = "SELECT crop, total, confirmed, unknown, ignored, greatest(total - confirmed - unknown - ignored, 0) AS needs_review, round_even(100.0 * (confirmed + unknown + ignored) / total, 0)::INT AS percent FROM p"
register("a04_review_progress", lambda i: m.review_progress(_fold(i)), f"WITH {_FOLD}, p AS (SELECT crop, count(*) AS total, count(*) FILTER (WHERE {_STATUS} = 'confirmed') AS confirmed, count(*) FILTER (WHERE {_STATUS} = 'unknown') AS unknown, count(*) FILTER (WHERE {_STATUS} = 'ignored') AS ignored FROM fold GROUP BY crop) {_PROGRESS}")
register("a04_review_progress_flags", lambda i: m.review_progress(_fold(i), exclusive=False), f"WITH {_FOLD}, p AS (SELECT crop, count(*) AS total, count(label) AS confirmed, count(*) FILTER (WHERE unknown) AS unknown, count(*) FILTER (WHERE ignored) AS ignored FROM fold GROUP BY crop) {_PROGRESS}")
register(
    "w19_next_unreviewed",
    lambda i: m.next_unreviewed(_open(i)),
    f"""WITH {_FOLD}, o AS (SELECT crop, slot, {_STATUS} = 'confirmed' AND (crop + slot) % 5 = 0 AS open FROM fold), x AS (SELECT crop, slot FROM o WHERE open)
    SELECT o.crop, o.slot, n.c AS next_crop, n.s AS next_slot FROM o LEFT JOIN LATERAL (SELECT x.crop AS c, x.slot AS s FROM x WHERE NOT (x.crop = o.crop AND x.slot = o.slot)
    ORDER BY CASE WHEN x.crop = o.crop AND x.slot > o.slot THEN 0 WHEN x.crop = o.crop THEN 1 WHEN x.crop > o.crop THEN 2 ELSE 3 END, x.crop, x.slot LIMIT 1) n ON true""",
)


def _open(i):
    opened = m.slot_status(F.col("label"), F.col("unknown"), F.col("ignored")) == "confirmed"
    return _fold(i).withColumn("label", F.when(~(opened & ((F.col("crop") + F.col("slot")) % 5 == 0)), F.coalesce("label", F.lit(-1))))


register("m11_rekey", lambda i: m.rekey(i.bundles.select(F.col("doc_id").alias("key"), "source"), i.bundles.filter("doc_id % 9 = 0").select(F.col("doc_id").alias("key"), (F.col("doc_id") + 1_000_000).alias("new_key")))[0], "SELECT CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000 ELSE doc_id END AS key, source FROM bundles")
register("m11_rekey_problems", lambda i: m.rekey(i.bundles.select(F.col("doc_id").alias("key"), "source"), i.bundles.filter("doc_id % 90 = 0").select((F.col("doc_id") * 3).alias("key"), (F.col("doc_id") + 1).alias("new_key")))[1], "WITH c AS (SELECT doc_id * 3 AS key, doc_id + 1 AS new_key FROM bundles WHERE doc_id % 90 = 0), o AS (SELECT coalesce(new_key, doc_id) AS key FROM bundles LEFT JOIN c ON c.key = doc_id) SELECT key, 'missing source' AS problem FROM c WHERE key NOT IN (SELECT doc_id FROM bundles) UNION ALL SELECT key, 'duplicate key' FROM o GROUP BY key HAVING count(*) > 1")
register("m12_promote_recovered", lambda i: m.promote_recovered(i.truth, i.starts.withColumn("page", F.expr("page + 1")), i.starts.filter("page % 10 = 0"), ["set_id", "bag"]), "WITH a AS (SELECT set_id, bag, page FROM truth UNION ALL SELECT s.set_id, s.bag, s.page + 1 FROM starts s ANTI JOIN truth t ON t.set_id = s.set_id AND t.bag = s.bag) SELECT a.* FROM a ANTI JOIN (SELECT * FROM starts WHERE page % 10 = 0) x ON x.set_id = a.set_id AND x.bag = a.bag")
_CANDS = "cands AS (SELECT set_id, bag, page + CAST(page % 2 = 0 AS INT) AS page, (page % 10 / 10.0)::DOUBLE AS confidence FROM starts UNION ALL SELECT set_id, bag, page, 0.5::DOUBLE FROM starts)"


def _cands(i):
    return i.starts.select("set_id", "bag", F.expr("page + cast(page % 2 = 0 as int) as page"), F.expr("page % 10 / 10.0D as confidence")).unionByName(i.starts.withColumn("confidence", F.lit(0.5)))


register("t05_best_per_key", lambda i: m.best_per_key(_cands(i)), f"WITH {_CANDS} SELECT *, row_number() OVER (PARTITION BY set_id, bag ORDER BY confidence DESC, page) > 1 AS discarded FROM cands")
register("m13_auto_confirm", lambda i: m.auto_confirm(_cands(i), i.truth), f"WITH {_CANDS}, b AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY set_id, bag ORDER BY confidence DESC, page) = 1) SELECT b.set_id, b.bag, b.page, b.confidence, t.page AS existing_page, CASE WHEN t.page <> b.page THEN 'skipped' ELSE 'confirmed' END AS outcome FROM b LEFT JOIN truth t USING (set_id, bag)")


def _entries(i, when, tag):
    return i.bundles.filter(when).select(F.col("doc_id").alias("bundle_id"), F.concat(F.lit(tag), "doc_id").alias("path"), F.expr("if(doc_id % 4 = 0, status, null)").alias("review"), F.expr(f"if(doc_id % 6 = 0, '{tag}', null)").alias("cloud"))


register("m14_bundle_register", lambda i: m.bundle_register(_entries(i, "doc_id % 3 <> 0", "old/"), _entries(i, "doc_id % 2 = 0", "new/").withColumn("review", F.lit(None).cast("string"))), "SELECT doc_id AS bundle_id, CASE WHEN doc_id % 2 = 0 THEN concat('new/', doc_id) ELSE concat('old/', doc_id) END AS path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN status END AS review, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'new/' ELSE 'old/' END END AS cloud FROM bundles WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
register("j21_truth_split", lambda i: m.truth_split(i.starts.withColumn("bag", F.expr("bag + cast(page % 5 = 0 as int)")), i.truth), "SELECT s.set_id, s.page, s.bag + CAST(s.page % 5 = 0 AS INT) AS bag, t.bag AS existing_bag, CASE WHEN t.bag IS NULL THEN 'save' WHEN t.bag = s.bag + CAST(s.page % 5 = 0 AS INT) THEN 'keep' ELSE 'same_page_different_bag_already_saved' END AS outcome FROM starts s LEFT JOIN truth t USING (set_id, page)")
register("a01_review_stats", lambda i: m.review_stats(i.bundles), "SELECT count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'needs_split_fix') AS needs_split_fix, count(*) FILTER (WHERE status = 'bad_mask') AS bad_mask, count(*) FILTER (WHERE coalesce(status, 'pending') = 'pending') AS pending FROM bundles")
register("u10_preserve_review", lambda i: m.preserve_review(i.starts.withColumn("status", F.lit("open")).withColumn("note", F.lit("auto")), i.truth.withColumn("status", F.expr("if(page % 2 = 0, 'accepted', 'open')")).withColumn("note", F.concat(F.lit("n"), "page"))), "SELECT s.set_id, s.bag, s.page, CASE WHEN t.page % 2 = 0 THEN 'accepted' ELSE 'open' END AS status, CASE WHEN t.page % 2 = 0 THEN concat('n', t.page) ELSE 'auto' END AS note FROM starts s LEFT JOIN truth t USING (set_id, bag)")
register("j29_truth_map", lambda i: m.truth_map(_cands(i)), f"WITH {_CANDS} SELECT set_id, bag, list_sort(list(DISTINCT page)) AS pages, min(page) AS first_page FROM cands GROUP BY ALL")
register("u12_gap_merge", lambda i: m.gap_merge(i.page_steps.filter("page % 2 = 0").select("set_id", "page", F.col("value").alias("step")), i.page_steps.filter("page % 3 = 0").select("set_id", "page", F.col("value").alias("step"))), "SELECT set_id, page, value AS step FROM page_steps WHERE page % 2 = 0 OR page % 3 = 0")
register(
    "m04_review_update_ids",
    lambda i: m.review_update(i.bundles.select("bundle_id", "status", F.expr("cast(if(doc_id % 2 = 0, -1, null) as int)").alias("page")).dropDuplicates(["bundle_id"]).withColumn("page", F.lit(None).cast("int")), i.bundles.filter("n_chars % 4 = 1").selectExpr("bundle_id", "'approved' AS new_status", "3 AS score", "doc_id AS seq"), f.bundle_fields(F.col("bundle_id")), ("page",))[0].select("bundle_id", "page", "score"),
    "SELECT bundle_id, CAST(any_value(n_chars) % 300 AS INT) AS page, CASE WHEN bool_or(n_chars % 4 = 1) THEN 3 END AS score FROM bundles GROUP BY bundle_id",
)
register(
    "m08_nested_updates",
    lambda i: m.nested_updates(i.bundles.selectExpr("doc_id", *(f"array(named_struct('index', cast(doc_id % {n} as int), 'status', 'open')) AS {c}" for c, n in (("quantity", 2), ("colour", 3), ("part", 5)))), ["quantity", "colour", "part"], F.lit(1), F.lit("done")).selectExpr("doc_id", "quantity[0].status AS quantity", "colour[0].status AS colour", "part[0].status AS part"),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'done' ELSE 'open' END AS quantity, CASE WHEN doc_id % 3 = 1 THEN 'done' ELSE 'open' END AS colour, CASE WHEN doc_id % 5 = 1 THEN 'done' ELSE 'open' END AS part FROM bundles",
)

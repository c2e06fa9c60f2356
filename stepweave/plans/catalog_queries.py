"""Queries of the catalog operators."""

from __future__ import annotations

from stepweave.functions import scalars as s
from stepweave.operators import catalog as c
from stepweave.plans.base import register

F = c.F
_LATEST = "latest AS (SELECT set_num, inventory_id FROM (SELECT *, row_number() OVER (PARTITION BY set_num ORDER BY version DESC, inventory_id DESC) AS nth FROM inventories) WHERE nth = 1)"
_REQ = f"""{_LATEST}, qty AS (SELECT set_num, part_num, color_id, sum(quantity)::BIGINT AS qty FROM requirements JOIN latest USING (inventory_id) GROUP BY ALL HAVING sum(quantity) > 0),
    req AS (SELECT q.*, e.element_id, i.img_url, k.name AS color_name, k.rgb, i.img_url IS NULL AS needs_image FROM qty q LEFT JOIN elements e USING (part_num, color_id) LEFT JOIN images i USING (part_num, color_id) LEFT JOIN colors k USING (color_id))"""


def _req(i):
    return c.set_requirements(i.inventories, i.requirements, i.elements, i.images, i.colors)


register("s03_catalog_scan", lambda i: i.part.select("p_partkey", "p_name", "p_size").filter("p_size > 10"), "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
register("j01_set_requirements", _req, f"WITH {_REQ} SELECT * FROM req")
register("j02_part_library", lambda i: c.part_library(i.requirements, i.elements, i.images, i.colors), "SELECT r.part_num, r.color_id, r.qty, r.sets, e.element_id, i.img_url, k.rgb FROM (SELECT part_num, color_id, sum(quantity)::BIGINT AS qty, count(DISTINCT inventory_id) AS sets FROM requirements GROUP BY ALL) r LEFT JOIN elements e USING (part_num, color_id) LEFT JOIN images i USING (part_num, color_id) LEFT JOIN colors k USING (color_id)")
_LISTED = "listed AS (SELECT DISTINCT v.set_num, e.element_id FROM requirements r JOIN inventories v ON v.inventory_id = r.inventory_id JOIN elements e ON e.part_num = r.part_num AND e.color_id = r.color_id), asked AS (SELECT set_num, element_id FROM listed UNION SELECT set_num + 1, element_id FROM listed)"


def _lookups(i):
    """Every element that a set lists, asked by that set and by the next one."""
    own = i.requirements.join(i.inventories, "inventory_id").join(i.elements, ["part_num", "color_id"]).select("set_num", "element_id")
    return own.unionByName(own.withColumn("set_num", F.col("set_num") + 1)).distinct()


register(
    "j03_element_lookup",
    lambda i: c.element_lookup(c.cut(_lookups(i)), i.elements, i.requirements, i.inventories, i.elements.filter("element_id % 2 = 0").withColumn("quantity", F.lit(-1))),
    f"""WITH {_LISTED},
    hits AS (SELECT a.set_num, a.element_id, e.part_num, e.color_id, r.quantity, row_number() OVER (PARTITION BY a.set_num, a.element_id ORDER BY CASE WHEN v.set_num = a.set_num THEN 0 ELSE 1 END, r.quantity DESC, r.inventory_id DESC) AS nth FROM asked a JOIN elements e USING (element_id) LEFT JOIN requirements r ON r.part_num = e.part_num AND r.color_id = e.color_id LEFT JOIN inventories v ON v.inventory_id = r.inventory_id WHERE v.set_num = a.set_num OR v.set_num IS NULL),
    f AS (SELECT element_id, part_num, color_id, -1 AS quantity FROM elements WHERE element_id % 2 = 0)
    SELECT a.set_num, a.element_id, CASE WHEN h.set_num IS NULL THEN f.part_num ELSE h.part_num END AS part_num, CASE WHEN h.set_num IS NULL THEN f.color_id ELSE h.color_id END AS color_id, CASE WHEN h.set_num IS NULL THEN f.quantity ELSE h.quantity END AS quantity
    FROM asked a LEFT JOIN (SELECT * FROM hits WHERE nth = 1) h ON h.set_num = a.set_num AND h.element_id = a.element_id LEFT JOIN f ON f.element_id = a.element_id""",
)
register(
    "j04_set_pairs",
    lambda i: c.set_pairs(i.inventories.select("set_num").distinct(), i.inventories.join(i.requirements, "inventory_id").filter("set_num % 3 = 0 and quantity > 20").select("set_num", "part_num", "color_id"), i.inventories, i.requirements, "flag = 'R'"),
    f"""WITH {_LATEST}, listed AS (SELECT DISTINCT set_num, part_num, color_id FROM inventories JOIN requirements USING (inventory_id) WHERE set_num % 3 = 0 AND quantity > 20)
    SELECT * FROM listed UNION ALL SELECT DISTINCT set_num, part_num, color_id FROM latest JOIN requirements USING (inventory_id) WHERE flag <> 'R' AND set_num NOT IN (SELECT set_num FROM listed)""",
)
_TOTALS = "totals AS (SELECT part_num, color_id, sum(CASE WHEN qty > 0 THEN qty ELSE 1 END)::BIGINT AS total, count(*) AS n FROM examples GROUP BY ALL)"
register(
    "j05_confirmed_usage",
    lambda i: c.confirmed_usage(i.examples.select("part_num", "color_id", F.expr("cast(part_num % 5 as int)").alias("quantity")), i.examples),
    f"WITH {_TOTALS}, r AS (SELECT part_num, color_id, sum(part_num % 5)::BIGINT AS required FROM examples GROUP BY ALL), j AS (SELECT part_num, color_id, required, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM r LEFT JOIN totals USING (part_num, color_id)) SELECT *, greatest(required - total, 0) AS remaining, greatest(total - required, 0) AS over FROM j",
)
register("j06_confirmed_memory", lambda i: c.confirmed_memory(i.examples.select("event_id", F.col("event_id").alias("element_id")), i.vectors.select(F.col("vec_id").alias("element_id"), "embedding"))[0].select("event_id", "element_id", F.bround(F.get("vector", F.lit(0)), 6).alias("first")), "SELECT event_id, event_id AS element_id, round_even(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS first FROM examples JOIN vectors ON vec_id = event_id")
register("a02_confirmed_totals", lambda i: c.confirmed_totals(i.examples), f"WITH {_TOTALS} SELECT * FROM totals")
register("a03_assigned_qty", lambda i: c.assigned_qty(i.examples), "SELECT part_num, color_id, sum(coalesce(nullif(qty, 0), 1))::BIGINT AS assigned FROM examples GROUP BY ALL")
register("a05_pool_max_qty", lambda i: c.pool_max_qty(i.requirements), "SELECT part_num, color_id, max(quantity) AS quantity FROM requirements GROUP BY ALL")
register("a10_duplicate_keys", lambda i: c.duplicate_keys(i.requirements, "part_num", "color_id"), "SELECT part_num, color_id, count(*) AS n FROM requirements GROUP BY ALL HAVING count(*) > 1")
register("a14_coverage_manifest", lambda i: c.coverage_manifest(i.examples.select((F.col("event_id") - F.col("event_id") % 3).alias("element_id")), i.vectors.select(F.col("vec_id").alias("element_id"))), "WITH d AS (SELECT event_id - event_id % 3 AS element_id, count(*) AS n FROM examples GROUP BY 1) SELECT count(*) AS elements, count(v.vec_id) AS matched, sum(n - 1)::BIGINT AS duplicates, count(v.vec_id) / count(*) AS ratio FROM d LEFT JOIN (SELECT DISTINCT vec_id FROM vectors) v ON v.vec_id = d.element_id")
register("a15_confirm_rollup", lambda i: c.confirm_rollup(i.examples), "WITH f AS (SELECT part_num, bundle, min((ts, event_id)) AS first FROM examples GROUP BY ALL) SELECT e.part_num, e.color_id, e.n, b.bundles FROM (SELECT part_num, arg_min(color_id, (ts, event_id)) AS color_id, count(*) AS n FROM examples GROUP BY 1) e JOIN (SELECT part_num, list(bundle ORDER BY first, bundle) AS bundles FROM f GROUP BY 1) b USING (part_num)")
register("a17_context_counts", lambda i: c.context_counts(_req(i)), f"WITH {_REQ} SELECT count(*) AS parts, sum(qty)::BIGINT AS total, count(*) FILTER (WHERE img_url IS NULL) AS without_image FROM req")


def _asked(i):
    return i.part.select(F.col("p_partkey").alias("query"), F.expr("array(cast(p_partkey * 37 % 256 as int), cast(p_partkey * 59 % 256 as int), cast(p_size * 5 as int))").alias("rgb"))


_NEAR = """pal AS (SELECT min(color_id) AS color_id, rgb, ('0x' || rgb[1:2])::INT AS r, ('0x' || rgb[3:4])::INT AS g, ('0x' || rgb[5:6])::INT AS b FROM colors GROUP BY rgb),
    asked AS (SELECT p_partkey AS query, p_partkey * 37 % 256 AS qr, p_partkey * 59 % 256 AS qg, p_size * 5 AS qb FROM part),
    d AS (SELECT query, color_id, sqrt((qr - r) ** 2 + (qg - g) ** 2 + (qb - b) ** 2) AS distance FROM asked, pal), near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, color_id) AS rank FROM d)"""
register("t08_nearest_colours", lambda i: c.nearest_colours(_asked(i), i.colors), f"WITH {_NEAR} SELECT query, rank, color_id, distance FROM near WHERE rank <= 6")
register("t03_colour_top5", lambda i: c.colour_top5(_asked(i), i.colors), f"WITH {_NEAR} SELECT query, rank, color_id, 1 / (1 + distance) AS score FROM near WHERE rank <= 5")


def _segments(i):
    return i.inventories.select("set_num", F.col("inventory_id").alias("segment"), F.expr("array(cast(inventory_id * 37 % 256 as int), cast(inventory_id * 59 % 256 as int), cast(inventory_id * 83 % 256 as int))").alias("rgb"), F.expr("inventory_id % 10 / 10.0D").alias("density"))


register(
    "j24_rgb_match",
    lambda i: c.rgb_match(_segments(i), _req(i)),
    f"""WITH {_REQ}, pool AS (SELECT set_num, part_num, color_id, ('0x' || rgb[1:2])::INT AS r, ('0x' || rgb[3:4])::INT AS g, ('0x' || rgb[5:6])::INT AS b FROM req WHERE rgb IS NOT NULL),
    seg AS (SELECT set_num, inventory_id AS segment, inventory_id * 37 % 256 AS qr, inventory_id * 59 % 256 AS qg, inventory_id * 83 % 256 AS qb, (inventory_id % 10 / 10.0)::DOUBLE AS density FROM inventories),
    m AS (SELECT set_num, segment, part_num, color_id, round(0.92::DOUBLE * greatest(0, least(1, 1 - sqrt((qr - r) ** 2 + (qg - g) ** 2 + (qb - b) ** 2) / 441.6729::DOUBLE)) + 0.08::DOUBLE * CASE WHEN density > 0 THEN greatest(0, least(1, 1 - abs(density - 0.55::DOUBLE))) ELSE 0.5 END, 4) AS score FROM seg JOIN pool USING (set_num)),
    k AS (SELECT *, row_number() OVER (PARTITION BY set_num, segment ORDER BY score DESC, part_num, color_id) AS rank FROM m) SELECT set_num, segment, rank, part_num, color_id, score FROM k WHERE rank <= 5""",
)
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE / n) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM vectors))"
_KNN = f"{_UNIT}, p AS (SELECT q.vec_id AS query, k.vec_id AS candidate, list_inner_product(q.v, k.v) AS score FROM u q JOIN u k ON q.vec_id % 50 = 0 AND k.vec_id <> q.vec_id AND k.label = q.label), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM p)"


def _knn(i):
    return c.knn_same_attr(i.vectors.filter("vec_id % 50 = 0"), i.vectors)


register("j25_knn_same_attr", lambda i: _knn(i).select("query", "rank", "candidate", F.bround("score", 9).alias("score")), f"WITH {_KNN} SELECT query, rank, candidate, round_even(score, 9) AS score FROM r WHERE rank <= 10")
register("j26_memory_score", lambda i: c.memory_score(i.vectors.filter("vec_id % 50 = 0"), i.vectors.select("vec_id", F.expr("vec_id % 100").alias("element_id"), "embedding"), least=0.3).withColumn("score", F.bround("score", 9)), f"WITH {_UNIT} SELECT q.vec_id AS query, k.vec_id % 100 AS element, round_even(max(list_inner_product(q.v, k.v)), 9) AS score FROM u q JOIN u k ON q.vec_id % 50 = 0 GROUP BY ALL HAVING max(list_inner_product(q.v, k.v)) >= 0.3")
register("a16_topk_accuracy", lambda i: c.topk_accuracy(_knn(i).withColumn("right", F.expr("candidate % 7 = query % 7"))), f"WITH {_KNN}, b AS (SELECT query, min(CASE WHEN candidate % 7 = query % 7 THEN rank END) AS rank FROM r WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS queries, count(*) FILTER (WHERE rank <= 1) AS hits_1, count(*) FILTER (WHERE rank <= 5) AS hits_5, count(*) FILTER (WHERE rank <= 10) AS hits_10 FROM b")
register("u11_expected_coverage", lambda i: c.expected_coverage(i.requirements.filter("quantity > 40"), i.requirements.filter("flag = 'A'")), "SELECT DISTINCT r.part_num, r.color_id, p.part_num IS NOT NULL AS present FROM requirements r LEFT JOIN (SELECT DISTINCT part_num, color_id FROM requirements WHERE flag = 'A') p USING (part_num, color_id) WHERE r.quantity > 40")
_STOCK = "stock AS (SELECT part_num, color_id, min(quantity) - 10 AS remaining FROM requirements GROUP BY ALL HAVING min(quantity) < 30)"
register(
    "j27_catalog_rank",
    lambda i: c.catalog_rank(_asked(i).withColumn("set_num", F.col("query")), i.images, i.colors, c.required_quantities(i.inventories, i.requirements).select("set_num", "part_num", "color_id"), i.requirements.groupBy("part_num", "color_id").agg(F.min("quantity").alias("q")).filter("q < 30").select("part_num", "color_id", (F.col("q") - 10).alias("remaining"))),
    f"""WITH {_NEAR}, {_REQ}, {_STOCK}, l AS (SELECT n.query, n.query AS set_num, n.color_id, n.distance, i.part_num, i.img_url, row_number() OVER (PARTITION BY n.query ORDER BY i.part_num, n.color_id) AS nth FROM near n JOIN images i USING (color_id) WHERE n.rank <= 6),
    x AS (SELECT l.*, CASE WHEN q.set_num IS NOT NULL THEN 1 END AS own, s.remaining FROM l LEFT JOIN (SELECT DISTINCT set_num, part_num, color_id FROM req) q ON q.set_num = l.set_num AND q.part_num = l.part_num AND q.color_id = l.color_id LEFT JOIN stock s ON s.part_num = l.part_num AND s.color_id = l.color_id WHERE nth <= 600),
    y AS (SELECT *, round_even(distance - CASE WHEN own = 1 THEN 60.0 ELSE 0.0 END - 5.0 + CASE WHEN remaining > 0 THEN -30.0 WHEN remaining IS NOT NULL THEN 90.0 ELSE 0.0 END, 3) AS score, count(own) OVER (PARTITION BY query) AS owned FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, part_num, color_id) AS rank FROM y WHERE owned < 10 OR own = 1) SELECT query, rank, part_num, color_id, score FROM z WHERE rank <= 20""",
)
_IMAGE_ROWS = ("part_num * 100000 + color_id AS element_id", "img_url AS image", "CASE WHEN part_num % 2 = 0 THEN part_num END AS part_num", "CAST(NULL AS BIGINT) AS color_id", "CAST(NULL AS INT) AS qty")
register("s10_image_manifest", lambda i: c.image_manifest(i.images.selectExpr(*_IMAGE_ROWS), i.elements.withColumn("qty", F.expr("cast(part_num % 7 as int)"))), f"WITH m AS (SELECT {', '.join(_IMAGE_ROWS)} FROM images) SELECT m.element_id, m.image, coalesce(m.part_num, e.part_num) AS part_num, e.color_id, CAST(e.part_num % 7 AS INT) AS qty FROM m LEFT JOIN elements e ON e.element_id = m.element_id")
register("a14_coverage_ids", lambda i: c.coverage_ids(i.examples.select((F.col("event_id") - F.col("event_id") % 3).alias("element_id")), i.vectors.select(F.col("vec_id").alias("element_id"))), "SELECT DISTINCT event_id - event_id % 3 AS element_id, (event_id - event_id % 3) IN (SELECT vec_id FROM vectors) AS matched FROM examples")
register("a15_reviewers", lambda i: c.confirm_rollup(i.examples.withColumn("reviewer", F.col("bundle") % 4)).select("part_num", "reviewers"), "WITH f AS (SELECT part_num, bundle % 4 AS reviewer, min((ts, event_id)) AS first FROM examples GROUP BY ALL) SELECT part_num, list(reviewer ORDER BY first, reviewer) AS reviewers FROM f GROUP BY 1")

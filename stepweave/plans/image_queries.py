"""Queries of the image jobs over grids made from the vectors."""

from __future__ import annotations

from stepweave.operators import images as g
from stepweave.plans.base import register

F = g.F
_GRID = "px AS (SELECT vec_id AS id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k, list_min(embedding) AS lo, list_max(embedding) AS hi FROM vectors), gray AS (SELECT id, (k % 8)::INT AS x, (k // 8)::INT AS y, least(255, floor(255::FLOAT * (v - lo) / (hi - lo)))::INT AS v FROM px)"
register("i01_layout_signals", lambda i: g.layout_signals(g.grid_images(i.vectors)))
register("i02_top_band", lambda i: g.top_band(g.grid_images(i.vectors)))
register("i03_dominant_colour", lambda i: g.dominant_colour(g.grid_images(i.vectors)))
register("i04_foreground_stats", lambda i: g.foreground_stats(g.grid_images(i.vectors), floor=160).select("id", "pixels", "x", "y", "w", "h"), f"WITH {_GRID} SELECT id, count(*)::INT AS pixels, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM gray WHERE v > 160 GROUP BY id")
register("i05_mask_islands", lambda i: g.mask_islands(g.grid_images(i.vectors).withColumn("data", F.unhex(F.regexp_replace(F.hex("data"), "[0-8]([0-9A-F])", "00"))), least=2))
register("i08_crop_extract", lambda i: g.crop_extract(g.grid_images(i.vectors), i.vectors.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("crop"), F.expr("cast(vec_id % 9 - 1 as int)").alias("x"), F.lit(-2).alias("y"), F.lit(4).alias("w"), F.lit(6).alias("h"))).select("id", "height", "width"), "SELECT vec_id AS id, 4 AS height, (least(8, vec_id % 9 + 3) - greatest(0, vec_id % 9 - 1))::INT AS width FROM vectors WHERE least(8, vec_id % 9 + 3) > greatest(0, vec_id % 9 - 1)")
register("i06_mask_stats", lambda i: g.mask_stats(g.grid_images(i.vectors), floor=100, cap=200, least=4))
register("i07_page_structure", lambda i: g.page_structure(g.grid_images(i.vectors), width=64))
register("i09_crop_normalize", lambda i: g.crop_normalize(g.grid_images(i.vectors)).select("id", "height", "width", "channels", F.sha2("data", 256).alias("data_sha256")))
_SIGNALS = ("set_id AS window", "page", "1 AS first", "90 AS last", "value % 4 AS arrows", "value % 6 AS groups", "page % 3 AS strong", "page % 2 AS central", "value * 30 AS pixels")
register(
    "i07_structure_scores", lambda i: g.structure_scores(i.page_steps.selectExpr(*_SIGNALS)).select("window", "page", "rank", "score", "candidate_score", "candidate"),
    f"""WITH s AS (SELECT {', '.join(_SIGNALS)} FROM page_steps), e AS (SELECT *, 1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, (page - first) / 89.0::DOUBLE)) AS early FROM s),
    k AS (SELECT *, round(CASE WHEN arrows > 0 THEN 35 * least(1.0::DOUBLE, arrows / 2.0::DOUBLE) ELSE -10.0::DOUBLE END + CASE WHEN strong > 0 THEN 28 * least(1.0::DOUBLE, strong / 2.0::DOUBLE) ELSE -8.0::DOUBLE END + 22 * least(1.0::DOUBLE, central) + 12 * early + CASE WHEN early <= 0.2::DOUBLE THEN -6.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN arrows > 0 AND strong > 0 THEN 18.0::DOUBLE WHEN arrows = 0 AND strong = 0 THEN -18.0::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score,
        round(0.58::DOUBLE * least(1.0::DOUBLE, groups / 5.0::DOUBLE) + 0.34::DOUBLE * least(1.0::DOUBLE, arrows / 3.0::DOUBLE) + 0.08::DOUBLE * least(1.0::DOUBLE, pixels / 2400.0::DOUBLE), 4) AS candidate_score FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, page) AS rank FROM k) SELECT "window", page, rank, score, candidate_score, groups >= 2 AND arrows >= 1 AND candidate_score >= 0.42 AS candidate FROM r WHERE rank <= 12""",
)


def _differences(i):
    """Each image against the next one."""
    pairs = i.vectors.select(g.F.col("vec_id").alias("crop"), (g.F.col("vec_id") + 1).alias("image"))
    return g.image_differences(pairs, g.shape_features(g.grid_images(i.vectors)))


register("j27_image_difference", _differences)

"""Queries of the sequence operators."""

from __future__ import annotations

from stepweave.operators import sequences as q
from stepweave.plans.base import register

_PAGES = "pages_of AS (SELECT set_id, page, min(CASE WHEN value > 0 THEN value END) AS step_min, max(CASE WHEN value > 0 THEN value END) AS step_max FROM page_steps GROUP BY set_id, page)"
_PREV = "last_value(step_max IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

register("a21_page_step_set", lambda i: q.page_step_set(i.multi_steps), "SELECT set_id, page, list_sort(list(DISTINCT value)) AS steps FROM multi_steps WHERE value > 0 GROUP BY set_id, page")
register(
    "w01_step_roles",
    lambda i: q.step_roles(i.page_steps),
    f"""WITH {_PAGES}, p AS (SELECT *, {_PREV} AS previous_max FROM pages_of), r AS (SELECT *, previous_max - step_min AS drop FROM p),
    s AS (SELECT *, CASE WHEN step_min IS NULL THEN 'no_step_data' WHEN previous_max >= 20 AND drop >= 10 AND step_min <= 3 THEN 'step_sequence_reset' WHEN step_min >= previous_max AND step_max >= previous_max THEN 'build_step_sequence_page' ELSE 'ambiguous' END AS role,
    coalesce(previous_max >= 20 AND drop >= 10 AND step_min <= 9, false) AS hero FROM r) SELECT *, role <> 'build_step_sequence_page' AS start_allowed FROM s""",
)
_SCORE = """round_even(CASE WHEN c <= 2 THEN 0.35 ELSE 0.0 END + CASE WHEN c = 1 THEN 0.15 ELSE 0.0 END + CASE WHEN previous >= 8 THEN 0.20 WHEN previous >= 6 THEN 0.10 ELSE 0.0 END
    + CASE WHEN previous - c >= 10 THEN 0.25 WHEN previous - c >= 6 THEN 0.18 WHEN previous - c >= 4 THEN 0.08 ELSE 0.0 END + CASE WHEN len(steps) >= 2 AND high <= 4 THEN 0.10 ELSE 0.0 END + CASE WHEN list_contains(steps, 1) AND list_contains(steps, 2) THEN 0.10 ELSE 0.0 END, 3)"""
register(
    "w02_reset_score",
    lambda i: (lambda d: d.select("set_id", "page", q.F.bround(d.confidence, 3).alias("confidence")))(q.reset_scan(i.page_steps).filter("previous is not null and confidence is not null")),
    f"""WITH p AS (SELECT set_id, page, list_sort(list(DISTINCT value)) AS steps, min(value) AS low, max(value) AS high FROM page_steps WHERE value > 0 GROUP BY ALL),
    v AS (SELECT *, last_value(CASE WHEN high <= 200 THEN high END IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, CASE WHEN list_contains(steps, 1) THEN 1 ELSE low END AS c FROM p)
    SELECT set_id, page, least(1.0, {_SCORE})::DOUBLE AS confidence FROM v WHERE high <= 200 AND previous IS NOT NULL""",
)
register(
    "w03_reset_scan",
    lambda i: q.reset_scan(i.page_steps).drop("confidence"),
    """WITH p AS (SELECT set_id, page, min(value) AS low, max(value) AS high, bool_or(value = 1) AS one FROM page_steps WHERE value > 0 GROUP BY ALL),
    v AS (SELECT *, last_value(CASE WHEN high <= 200 THEN high END IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM p),
    d AS (SELECT *, CASE WHEN high <= 200 THEN previous - CASE WHEN one THEN 1 ELSE low END END AS drop FROM v),
    b AS (SELECT *, coalesce(high <= 200 AND one AND previous >= 10 AND drop >= 10, false) AS bag_start FROM d)
    SELECT set_id, page, low, high, previous, drop, bag_start, CASE WHEN high > 200 THEN 'implausible step' WHEN bag_start THEN 'reset' WHEN drop > 0 THEN 'rejected reset' ELSE '' END AS reason FROM b""",
)
register("w04_min_spacing", lambda i: q.min_spacing(q.reset_scan(i.page_steps, least=2).filter("drop >= 10")))
register("w05_missing_numbers", lambda i: q.missing_numbers(i.truth), "WITH t AS (SELECT set_id, max(bag) AS top FROM truth GROUP BY set_id), n AS (SELECT set_id, unnest(range(1, top + 1))::INT AS bag FROM t) SELECT set_id, bag FROM n ANTI JOIN truth USING (set_id, bag)")
_WINDOWS = """t AS (SELECT set_id, max(bag) AS top FROM truth GROUP BY set_id), n AS (SELECT set_id, unnest(range(1, top + 1))::INT AS bag FROM t), m AS (SELECT set_id, bag FROM n ANTI JOIN truth USING (set_id, bag)),
    w AS (SELECT m.set_id, m.bag, p.bag AS previous_bag, p.page AS previous_page, x.bag AS next_bag, x.page AS next_page FROM m
    LEFT JOIN truth p ON p.set_id = m.set_id AND p.bag = (SELECT max(bag) FROM truth q WHERE q.set_id = m.set_id AND q.bag < m.bag)
    LEFT JOIN truth x ON x.set_id = m.set_id AND x.bag = (SELECT min(bag) FROM truth q WHERE q.set_id = m.set_id AND q.bag > m.bag))"""
register("w06_missing_windows", lambda i: q.missing_windows(i.truth), f"WITH {_WINDOWS} SELECT *, previous_page IS NOT NULL OR next_page IS NOT NULL AS bounded, coalesce(next_page - previous_page >= 2, false) AS scannable FROM w")
_RANGES = "ranges AS (SELECT set_id, bag, page AS start_page, coalesce(lead(page) OVER (PARTITION BY set_id ORDER BY page) - 1, last_page) AS end_page FROM starts JOIN manual USING (set_id))"
register("w07_ranges_from_starts", lambda i: q.ranges_from_starts(i.starts, i.manual), f"WITH {_RANGES} SELECT * FROM ranges")
register(
    "w08_gap_clusters",
    lambda i: q.gap_clusters(i.starts),
    """WITH f AS (SELECT set_id, page, CASE WHEN page - lag(page) OVER (PARTITION BY set_id ORDER BY page) <= 6 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT set_id, page FROM starts)),
    c AS (SELECT set_id, page, sum(fresh) OVER (PARTITION BY set_id ORDER BY page) AS cluster FROM f) SELECT set_id, cluster::BIGINT AS cluster, min(page) AS start_page, max(page) AS end_page, count(*) AS pages FROM c GROUP BY set_id, cluster""",
)
_RUNS = "runs AS (SELECT set_id, min(value) AS first, max(value) AS last, count(*) AS length FROM (SELECT set_id, value, value - row_number() OVER (PARTITION BY set_id ORDER BY value) AS island FROM (SELECT DISTINCT set_id, value FROM page_steps)) GROUP BY set_id, island)"
register("w09_consecutive_runs", lambda i: q.consecutive_runs(i.page_steps.withColumn("value", q.F.expr("value div 3"))), f"WITH {_RUNS.replace('FROM page_steps', 'FROM (SELECT set_id, value // 3 AS value FROM page_steps)')} SELECT * FROM runs")
_THIRD = "(SELECT set_id, value // 3 AS value FROM page_steps)"
_VISIBLE = f"{_RUNS.replace('FROM page_steps', f'FROM {_THIRD}')}, e AS (SELECT DISTINCT set_id, value FROM {_THIRD} WHERE value % 4 = 0 AND set_id % 5 <> 0), visible AS (SELECT * FROM runs r WHERE length >= 3 AND (EXISTS (SELECT 1 FROM e WHERE e.set_id = r.set_id AND e.value BETWEEN r.first AND r.last) OR NOT EXISTS (SELECT 1 FROM e WHERE e.set_id = r.set_id)))"


def _third(i):
    return i.page_steps.select("set_id", q.F.expr("cast(value div 3 as int)").alias("value"))


def _emitted(i):
    return _third(i).filter("value % 4 = 0 and set_id % 5 <> 0")


register("w09_visible_runs", lambda i: q.visible_runs(_third(i), _emitted(i)), f"WITH {_VISIBLE} SELECT * FROM visible")
register("w10_completeness", lambda i: q.completeness(_third(i), _emitted(i)), f"WITH {_VISIBLE}, x AS (SELECT set_id, unnest(range(first, last + 1)) AS value FROM visible) SELECT set_id, value FROM x ANTI JOIN e USING (set_id, value)")
register(
    "w11_gap_threshold",
    lambda i: q.gap_threshold(i.starts, least=4),
    """WITH d AS (SELECT set_id, page, lead(page) OVER (PARTITION BY set_id ORDER BY page) AS next_page FROM starts), g AS (SELECT *, next_page - page AS delta FROM d WHERE next_page IS NOT NULL),
    t AS (SELECT set_id, greatest(4, round_even(median(delta) * 1.5, 0)::INT) AS threshold FROM g GROUP BY set_id) SELECT set_id, page, next_page, delta, threshold FROM g JOIN t USING (set_id) WHERE delta >= threshold""",
)
register("w14_context_outliers", lambda i: q.context_outliers(i.page_steps))
register(
    "w17_sequence_gaps",
    lambda i: q.sequence_gaps(i.page_steps),
    """WITH k AS (SELECT set_id, value, min(page) AS page FROM page_steps GROUP BY set_id, value), l AS (SELECT set_id, value AS left_step, page AS left_page, lead(value) OVER w AS right_step, lead(page) OVER w AS right_page FROM k WINDOW w AS (PARTITION BY set_id ORDER BY value, page)),
    g AS (SELECT *, unnest(range(left_step + 1, right_step))::INT AS step FROM l WHERE right_step - left_step > 1)
    SELECT set_id, step, CASE WHEN right_page - left_page IN (0, 1) THEN left_page WHEN right_page - left_page = 2 THEN left_page + 1 ELSE left_page + greatest(0, round_even((right_page - left_page) * (step - left_step) / (right_step - left_step), 0)::INT) END AS page, left_step, right_step FROM g""",
)


def _jumpy(i):
    return i.starts.withColumn("bag", q.F.expr("bag - cast(page % 4 = 0 and bag > 2 as int)"))


_W18 = """WITH RECURSIVE c AS (SELECT set_id, page, bag - CAST(page % 4 = 0 AND bag > 2 AS INT) AS bag FROM starts),
    taken AS (SELECT DISTINCT set_id, 0 AS n, -1 AS page FROM c UNION ALL SELECT t.set_id, t.n + 1, m.page FROM taken t, LATERAL (SELECT min(page) AS page FROM c WHERE c.set_id = t.set_id AND c.bag = t.n + 1 AND c.page > t.page) m WHERE m.page IS NOT NULL),
    e AS (SELECT c.set_id, c.page, c.bag, (SELECT max(n) + 1 FROM taken t WHERE t.set_id = c.set_id AND t.page < c.page) AS expected FROM c)
    SELECT set_id, page, bag, bag = expected AS accepted, CASE WHEN bag = expected THEN '' WHEN bag < expected THEN 'already passed' ELSE 'not the next number' END AS reason FROM e"""
register("w18_consecutive_accept", lambda i: q.consecutive_accept(_jumpy(i)), _W18)
register("w18_accept_in_ranges", lambda i: q.consecutive_accept(_jumpy(i), pages=25), _W18)
_ASOF = "lastc AS (SELECT p.set_id, p.page, coalesce((SELECT max_by(t.bag, t.page * 100000 + t.bag) FROM truth t WHERE t.set_id = p.set_id AND t.page < p.page), 0) AS last_bag FROM page_steps p)"
register("j10_asof_last_confirmed", lambda i: q.asof_last_confirmed(i.page_steps, i.truth), f"WITH {_ASOF} SELECT * FROM lastc")
register("w20_infer_number", lambda i: q.infer_number(i.page_steps, i.truth), f"WITH {_ASOF} SELECT a.set_id, a.page, coalesce(t.bag, a.last_bag + 1) AS bag, CASE WHEN t.bag IS NOT NULL THEN 'existing_truth_same_page' ELSE 'last_confirmed_bag_sequence' END AS source FROM lastc a LEFT JOIN truth t USING (set_id, page)")
register("w21_dominant_step", lambda i: q.dominant_step(i.multi_steps), "SELECT set_id, page, max(value) AS dominant FROM multi_steps WHERE value >= 10 GROUP BY set_id, page")
register("w22_substep_filter", lambda i: q.substep_filter(i.multi_steps, least=5), "SELECT m.set_id, m.page, m.value, d.dominant FROM multi_steps m JOIN (SELECT set_id, page, max(value) AS dominant FROM multi_steps WHERE value >= 5 GROUP BY set_id, page) d USING (set_id, page) WHERE m.value BETWEEN 1 AND 9")
register(
    "w23_infer_valid_steps",
    lambda i: q.infer_valid_steps(i.page_steps, i.page_steps.filter("page % 3 <> 0")),
    """WITH h AS (SELECT set_id, page, min(value) AS low, max(value) AS high FROM page_steps WHERE page % 3 <> 0 GROUP BY set_id, page), r AS (SELECT p.set_id, p.page, h.low, h.high, CASE WHEN h.high IS NULL THEN NULL ELSE p.page END AS seen FROM (SELECT DISTINCT set_id, page FROM page_steps) p LEFT JOIN h USING (set_id, page)),
    n AS (SELECT *, last_value(high IGNORE NULLS) OVER b AS ph, last_value(seen IGNORE NULLS) OVER b AS pp, first_value(low IGNORE NULLS) OVER a AS nl FROM r WINDOW b AS (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY set_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT set_id, page, ph + page - pp AS step FROM n WHERE high IS NULL AND ph + page - pp < nl""",
)
register("w31_known_sequence", lambda i: q.known_sequence(q.gap_clusters(i.starts)).drop("cluster"), """WITH f AS (SELECT set_id, page, CASE WHEN page - lag(page) OVER (PARTITION BY set_id ORDER BY page) <= 6 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT set_id, page FROM starts)),
    c AS (SELECT set_id, page, sum(fresh) OVER (PARTITION BY set_id ORDER BY page) AS bag FROM f) SELECT set_id, bag::INT AS bag, min(page) AS start_page, max(page) AS end_page, count(*) AS pages FROM c GROUP BY set_id, bag""")
register(
    "a12_bag_step_range",
    lambda i: q.bag_step_range(i.starts, i.manual, i.page_steps),
    f"""WITH {_RANGES}, n AS (SELECT r.set_id, r.bag, p.value, row_number() OVER (PARTITION BY r.set_id, r.bag ORDER BY p.page) AS nth FROM ranges r JOIN page_steps p ON p.set_id = r.set_id AND p.page BETWEEN r.start_page AND r.end_page)
    SELECT r.set_id, r.bag, r.start_page, r.end_page, m.max_step, coalesce(m.pages_read, 0) AS pages_read FROM ranges r LEFT JOIN (SELECT set_id, bag, max(value) AS max_step, count(*) AS pages_read FROM n WHERE nth <= 15 GROUP BY set_id, bag) m USING (set_id, bag)""",
)
register("w12_gap_promotion", lambda i: q.gap_promotion(*(i.multi_steps.select("set_id", "page", q.F.expr("cast((value + 1) / 2 as int)").alias("value"), q.F.col("h").alias("box"), q.F.col("score").alias("confidence")).filter(w) for w in ("box % 3 > 0", "box % 3 = 0"))))
register(
    "w31_sequence_evidence", lambda i: q.sequence_evidence(q.gap_clusters(i.starts), i.starts.select("set_id", "page", (q.F.col("bag") / 10.0).alias("confidence"))),
    """WITH f AS (SELECT set_id, page, bag, CASE WHEN page - lag(page) OVER (PARTITION BY set_id ORDER BY page) <= 6 THEN 0 ELSE 1 END AS fresh FROM starts), c AS (SELECT set_id, page, bag, sum(fresh) OVER (PARTITION BY set_id ORDER BY page) AS k FROM f)
    SELECT set_id, k::INT AS bag, min(page) AS start_page, max(page) AS end_page, avg(bag / 10.0::DOUBLE) AS confidence, list(page ORDER BY page) AS evidence FROM c GROUP BY set_id, k""",
)
register(
    "j10_asof_with_provisional", lambda i: q.asof_with_provisional(i.page_steps, i.truth, i.starts.filter("page % 4 = 0").select("set_id", "page", (q.F.col("bag") * 2).alias("bag"))),
    f"""WITH {_ASOF}, v AS (SELECT set_id, page, bag * 2 AS bag FROM starts WHERE page % 4 = 0), m AS (SELECT l.set_id, l.page, max(v.bag) AS most FROM lastc l LEFT JOIN v ON v.set_id = l.set_id AND v.page < l.page GROUP BY ALL)
    SELECT set_id, page, greatest(last_bag, coalesce(most, 0)) AS last_bag FROM lastc JOIN m USING (set_id, page)""",
)

"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stepweave.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SELECT over driver tables and earlier names
FIXTURES: dict[str, str] = {
    # one printed step for each page of a manual
    "page_steps": "SELECT user_id AS set_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS page, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 3 + 1 AS value FROM events",
    # several steps on a page
    "multi_steps": "SELECT l_suppkey AS set_id, CAST(l_orderkey AS INT) AS page, l_linenumber * 2 - 1 AS value, CAST(l_quantity AS INT) AS h, l_discount AS score FROM lineitem WHERE l_suppkey IS NOT NULL",
    # section starts, every third one missing
    "starts": "SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY page) AS INT) AS bag, page FROM (SELECT set_id, page, value, lag(value) OVER (PARTITION BY set_id ORDER BY page) AS before FROM page_steps) WHERE before - value >= 100",
    "truth": "SELECT set_id, bag, page FROM starts WHERE bag % 3 <> 0",
    # what a page scan reports
    "evidence": "SELECT set_id, page, value, CASE WHEN value % 4 = 1 THEN page % 9 + 1 END AS detected, value % 3 > 0 AS number_found, value * 400 AS number_area, page % 11 = 0 AS card, page % 13 = 0 AS white_box, page % 5 = 0 AS strict_panel, page % 17 = 0 AS several_steps, CASE WHEN page % 6 = 0 THEN page % 9 + 1 END AS expected, page % 19 <> 0 AS allowed, page % 60 AS nx, value % 40 AS ny, value % 70 AS sx, page % 50 AS sy FROM page_steps",
    "manual": "SELECT set_id, max(page) AS last_page FROM page_steps GROUP BY set_id",
    # tokens and boxes on a page
    "boxes": "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS box, CAST(l_partkey % 1000 AS INT) AS x, CAST((l_suppkey * 37) % 800 AS INT) AS y, CAST(10 + 5 * l_linenumber AS INT) AS w, CAST(12 + CAST(l_quantity AS INT) % 30 AS INT) AS h, concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), 'x') AS text, l_discount AS score, l_shipdate, l_suppkey, l_partkey FROM lineitem",
    # catalog of parts and colours
    "inventories": "SELECT o_orderkey AS inventory_id, o_custkey AS set_num, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version FROM orders",
    "requirements": "SELECT l_orderkey AS inventory_id, l_partkey AS part_num, l_suppkey AS color_id, CAST(l_quantity AS INT) AS quantity, l_returnflag AS flag FROM lineitem",
    "elements": "SELECT DISTINCT l_partkey * 100000 + l_suppkey AS element_id, l_partkey AS part_num, l_suppkey AS color_id FROM lineitem",
    "images": "SELECT part_num, color_id, concat('img/', CAST(element_id AS VARCHAR(20)), '.png') AS img_url FROM elements WHERE element_id % 5 <> 0",
    "colors": "SELECT s_suppkey AS color_id, s_name AS name, lower(lpad(hex((s_suppkey * 7919) % 16777216), 6, '0')) AS rgb FROM supplier",
    # bundles, their review and examples
    "bundles": "SELECT d.doc_id, concat(CAST(70000 + d.doc_id % 50 AS VARCHAR(9)), '_bag', CAST(d.doc_id % 7 AS VARCHAR(9)), '_p', CAST(d.n_chars % 300 AS VARCHAR(9)), '_s', CAST(d.doc_id % 40 AS VARCHAR(9)), '_c', CAST(d.doc_id % 3 AS VARCHAR(9))) AS bundle_id, CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' WHEN d.doc_id % 2 = 0 THEN 'bad_mask' ELSE 'needs_split_fix' END AS status, d.source, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "examples": "SELECT event_id, user_id AS bundle, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS candidate_index, event_id % 200 AS part_num, event_id % 10 AS color_id, CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 END AS qty, ts FROM events WHERE event_type = 'purchase'",
    "label_events": "SELECT user_id AS crop, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6 AS slot, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'unknown' ELSE 'ignored' END AS kind, event_id % 500 AS label FROM events WHERE event_type IN ('purchase', 'view', 'error')",
    # votes of several readings
    "votes": "SELECT l_orderkey AS key, CAST(l_linenumber % 3 AS INT) AS value, l_discount AS confidence, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS text FROM lineitem",
    # a listing of scanned pages
    "listing": "SELECT doc_id, concat('scans/', CAST(70000 + doc_id % 20 AS VARCHAR(9)), '/run', CAST(doc_id % 3 AS VARCHAR(9)), '/page_', lpad(CAST(doc_id % 400 AS VARCHAR(9)), 3, '0'), CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.png' END) AS path, (doc_id * 7919) % 100003 AS modificationTime, text FROM documents",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
}
_NAME = re.compile(r"\b[a-z_]+\b")


def needs(sql: str) -> list[str]:
    """Fixtures that ``sql`` uses, each after those it builds on."""
    found: list[str] = []
    for name in FIXTURES:
        if name in _NAME.findall(re.sub(r"'[^']*'", "", sql)) and name not in found:
            found += [n for n in needs(FIXTURES[name]) if n not in found] + [name]
    return found


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or a driver table as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = FIXTURES[name].replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")
    words = set(_NAME.findall(re.sub(r"'[^']*'", "", sql)))
    used = {n: fixture(spark, sf_dir, n) for n in (*TABLES, *FIXTURES) if n in words and re.search(rf"(?:FROM|JOIN) {n}\b", sql)}
    for n in used:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql.replace("'{'", "'{{'"), **used)


def oracle(select: str) -> str:
    """``select`` with the fixtures it uses before it."""
    heads = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in needs(select))
    own = select.strip()
    if not heads:
        return own
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {own[15:]}"
    return f"WITH {heads}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {heads} {own}"

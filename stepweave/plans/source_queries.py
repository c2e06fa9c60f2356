"""Queries of sources, sinks and streams over listings, documents and event streams made of the driver's tables."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame

from stepweave.operators import pages as p, state as m, stored
from stepweave.plans.base import Inputs, register
from stepweave.plans.state_queries import _EX, _FOLD, _STATUS, _UPSERT, _batch, _ex
from stepweave.session import shared_dir
from stepweave.sources import files, sqlite
from stepweave.sources.versioned import Store
from stepweave.streaming import incremental as x

F = m.F
_LISTED = "WITH l AS (SELECT *, CAST(70000 + doc_id % 20 AS VARCHAR) AS set_num, concat('run', doc_id % 3) AS run, (doc_id % 400)::INT AS page FROM listing WHERE doc_id % 11 <> 0)"
register("s02_page_list", lambda i: files.page_list(i.listing), f"{_LISTED} SELECT set_num, run, page, path, modificationTime FROM l")
register("s01_page_run_latest", lambda i: files.page_run_latest(i.listing), f"{_LISTED}, b AS (SELECT set_num, arg_max(run, (modificationTime, run)) AS run FROM l GROUP BY 1) SELECT set_num, run, page, path, modificationTime FROM l JOIN b USING (set_num, run)")
register("s11_content_hash", lambda i: files.content_hash(i.listing.select(F.concat_ws("#", "path", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))), "SELECT concat(path, '#', doc_id) AS path, sha256(text) AS sha256 FROM listing")
register("s13_latest_artifact", lambda i: files.latest_artifact(i.listing, "scans/([0-9]+)/run[12]/"), "SELECT CAST(70000 + doc_id % 20 AS VARCHAR) AS key, arg_max(path, (modificationTime, path)) AS path FROM listing WHERE doc_id % 3 > 0 GROUP BY 1")


def _index(i: Inputs) -> DataFrame:
    return files.page_index(i.listing.select("path", "modificationTime", F.col("text").cast("binary").alias("content")))


register("k06_page_index", _index, f"{_LISTED} SELECT set_num, page, path, sha256(text) AS sha256 FROM l")
register("k06_run_manifest", lambda i: files.run_manifest(_index(i)), f"{_LISTED} SELECT set_num, count(*) AS pages, min(page) AS first_page, max(page) AS last_page, count(DISTINCT sha256(text)) AS contents FROM l GROUP BY 1")
register(
    "s03_catalog_tables",
    lambda i: (lambda t: t["part"].select(F.lit("part").alias("name"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size")).unionByName(t["supplier"].select(F.lit("supplier").alias("name"), F.col("s_suppkey").alias("id"), F.lit(None).cast("int").alias("size"))))(files.catalog_scan(i.spark, i.sf_dir, {"part": "p_partkey long, p_size int", "supplier": "s_suppkey long"})),
    "SELECT 'part' AS name, p_partkey AS id, p_size AS size FROM part UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier",
)
register("s07_truth_rows", lambda i: files.truth_import(i.truth.unionByName(i.truth.withColumn("page", F.col("page") + 1)).unionByName(i.truth.withColumn("bag", F.lit(0))), "old_run"), "SELECT set_id, bag, min(page) AS start_page, 'old_run' AS source, 1.0::DOUBLE AS confidence FROM truth GROUP BY ALL")


def _documents(i: Inputs) -> DataFrame:
    """One manifest of each conversation, a bare list or under ``entries``."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = i.conversations.groupBy("conv_id").agg(listed.alias("entries"))
    return rows.select(F.col("conv_id").alias("file"), F.when(F.xxhash64("conv_id") % 2 == 0, F.to_json("entries")).otherwise(F.to_json(F.struct("entries"))).alias("value"))


register("s04_manifest_entries", lambda i: files.manifest_entries(_documents(i), "turn long, role string"), "SELECT conv_id AS file, turn, role FROM conversations")


def _path(i: Inputs, name: str) -> str:
    return f"{shared_dir(i.spark)}/{name}/{uuid4().hex}"


def _written_json(i: Inputs) -> DataFrame:
    path = _path(i, "json")
    files.json_sink(i.bundles.select("bundle_id", "n_chars", "status"), path, "status")
    return files.json_table(i.spark, path)


register("k01_json_sink", _written_json, "SELECT bundle_id, n_chars, status FROM bundles")


def _written_tsv(i: Inputs) -> DataFrame:
    path = _path(i, "tsv")
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, F.lit("long")), F.when(F.col("doc_id") % 3 == 0, F.lit("third"))))
    files.tsv_sink(i.bundles.select("doc_id", flags.alias("flags")), path, "flags")
    return files.tsv_table(i.spark, path)


register("k02_tsv_sink", _written_tsv, "SELECT doc_id, nullif(concat_ws('|', CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN doc_id % 3 = 0 THEN 'third' END), '') AS flags FROM bundles")


def _scanned_crops(i: Inputs) -> DataFrame:
    path = _path(i, "crops")
    files.json_sink(i.bundles.selectExpr("if(doc_id % 8 = 0, '', bundle_id) AS crop_id", "doc_id", "doc_id % 50 AS set_num"), path, "set_num")
    return files.crop_cache(files.json_table(i.spark, path).selectExpr("crop_id", "doc_id", "cast(set_num AS int) AS set_num"))


register("s05_crop_cache_scan", _scanned_crops, "SELECT bundle_id AS crop_id, doc_id, (doc_id % 50)::INT AS set_num, (doc_id % 3)::INT AS crop_index FROM bundles WHERE doc_id % 8 <> 0")


def _states(i: Inputs) -> DataFrame:
    fold = m.label_event_fold(i.label_events)
    parts = fold.groupBy("crop").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "label"))), lambda s: F.struct(s["label"].alias("label"))).alias("parts"), F.max(F.col("ignored").cast("int")).alias("ignored"))
    crop = F.struct(F.concat(F.lit("crop"), F.col("crop")).alias("key"), F.struct(F.when(F.col("ignored") == 1, "held").otherwise("open").alias("status"), "parts").alias("value"))
    rows = parts.groupBy((F.col("crop") % 5).alias("set_num"), (F.col("crop") % 3).alias("bag")).agg(F.map_from_entries(F.collect_list(crop)).alias("crops"))
    return files.review_state(rows).select("set_num", "bag", "crop_id", "status", "slot", F.col("part.label").alias("label"))


register("s06_review_state_scan", _states, f"WITH {_FOLD}, h AS (SELECT crop, CASE WHEN bool_or(ignored) THEN 'held' ELSE 'open' END AS status FROM fold GROUP BY 1) SELECT crop % 5 AS set_num, crop % 3 AS bag, concat('crop', crop) AS crop_id, status, (row_number() OVER (PARTITION BY crop ORDER BY slot) - 1)::INT AS slot, label FROM fold JOIN h USING (crop)")
_SLOT_COLUMNS = ("doc_id AS slot", "concat('page/', doc_id % 40, '.png') AS page_path", "CASE WHEN doc_id % 3 = 0 THEN concat('cache/', doc_id, '.png') ELSE concat('crop/', doc_id % 90, '.jpg') END AS crop_path", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('cut/', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.png' END) END AS cutout_path")
register(
    "k04_asset_skips", lambda i: p.asset_skips(i.bundles.selectExpr(*_SLOT_COLUMNS)),
    f"""WITH s AS (SELECT {', '.join(_SLOT_COLUMNS)} FROM bundles), u AS (SELECT 'page_path' AS role, page_path AS path, false AS skip FROM s UNION ALL SELECT 'crop_path', crop_path, slot % 3 = 0 FROM s UNION ALL SELECT 'cutout_path', cutout_path, slot % 5 = 0 FROM s WHERE cutout_path IS NOT NULL),
    k AS (SELECT role, count(*) AS paths, count(*) FILTER (WHERE skip) AS skipped, count(DISTINCT path) FILTER (WHERE NOT skip) AS sent FROM u GROUP BY 1) SELECT *, paths - skipped - sent AS repeated FROM k""",
)
register(
    "k05_bundle_files",
    lambda i: files.bundle_manifest(i.bundles.select("bundle_id", "status", F.expr("map('page', concat('a/', doc_id, '.png'))").alias("artifacts"), F.expr("array(concat('c/', doc_id % 100, '.png'))").alias("cutouts")), i.documents.select(F.expr("concat('c/', doc_id % 70, '.png')").alias("path"), F.col("n_chars").alias("length"))),
    """WITH b AS (SELECT * FROM bundles WHERE status = 'approved'), f AS (SELECT concat('c/', doc_id % 70, '.png') AS path, max(n_chars) AS size FROM documents GROUP BY 1), r AS (SELECT bundle_id, 'page' AS role, concat('a/', doc_id, '.png') AS path, concat('bundles/', bundle_id, '/', doc_id, '.png') AS target FROM b UNION ALL SELECT bundle_id, 'slot_cutout_0', concat('c/', doc_id % 100, '.png'), concat('bundles/', bundle_id, '/', doc_id % 100, '.png') FROM b)
    SELECT path, bundle_id, role, target, size, size IS NOT NULL AS exists FROM r LEFT JOIN f USING (path)""",
)


def _streamed(i: Inputs, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` written, streamed through ``make`` until nothing is left, and the sink read back."""
    path = _path(i, "streams")
    rows.write.parquet(f"{path}/in")
    made = make(i.spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(made.schema).parquet(f"{path}/out")


def _timed(i: Inputs) -> DataFrame:
    """Page steps a minute apart, and a row far ahead that moves the watermark past them."""
    last = i.manual.agg(F.lit(-1).cast("long").alias("set_id"), F.lit(1).alias("page"), F.lit(1).alias("value"), F.timestamp_seconds(F.max("last_page").cast("long") * 60 + 10_000_000).alias("ts"))
    return i.page_steps.withColumn("ts", F.timestamp_seconds(F.col("page").cast("long") * 60)).unionByName(last)


register("x01_incremental_scan", lambda i: _streamed(i, i.truth.select("set_id", "page", "bag"), x.incremental_scan), "SELECT set_id, page, bag, least(bag, 3) AS expected, bag <= 2 AS accepted, CASE WHEN bag <= 2 THEN '' ELSE 'not the next number' END AS reason FROM truth")
register(
    "x04_reset_stream", lambda i: _streamed(i, _timed(i), x.reset_stream),
    """WITH v AS (SELECT set_id, page, value AS low, value AS high, last_value(CASE WHEN value <= 200 THEN value END IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM page_steps)
    SELECT *, coalesce(high <= 200 AND low = 1 AND previous >= 11, false) AS bag_start, false AS late FROM v""",
)
register(
    "x03_truth_conflicts", lambda i: _streamed(i, i.page_steps.selectExpr("set_id", "cast(value % 20 AS int) AS bag", "page - page % 7 AS page", "cast(page AS long) AS ordinal"), x.truth_conflicts),
    """WITH d AS (SELECT set_id, (value % 20)::INT AS bag, page - page % 7 AS page, page::BIGINT AS ordinal FROM page_steps), h AS (SELECT *, first_value(page) OVER (PARTITION BY set_id, bag ORDER BY ordinal) AS held, row_number() OVER (PARTITION BY set_id, bag ORDER BY ordinal) AS nth FROM d)
    SELECT set_id, bag, page, ordinal, CASE WHEN nth = 1 THEN 'inserted' WHEN page = held THEN 'exists' ELSE 'conflict' END AS status, CASE WHEN page <> held THEN held END AS existing_page FROM h""",
)


def _review_table(i: Inputs) -> DataFrame:
    path = _path(i, "reviews")
    i.label_events.select("crop", "slot", "kind", "label", "ts", "seq").write.parquet(f"{path}/in")
    x.review_events(i.spark.readStream.schema(i.label_events.schema).parquet(f"{path}/in"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return x.folded(i.spark, f"{path}/table").select("crop", "slot", m.slot_status(F.col("label"), F.col("unknown"), F.col("ignored")).alias("status"))


register("x02_review_events", _review_table, f"WITH {_FOLD} SELECT crop, slot, {_STATUS} AS status FROM fold")


def _truth_store(i: Inputs) -> Store:
    """Truth, then two batches of which the second comes twice, each in one commit with the conflicts."""
    store, batch = Store(i.spark, _path(i, "truth")), _batch(i)
    store.write({"truth": i.truth.select("set_id", "bag", "page")})
    for part in (0, 5, 5):
        stored.truth_upsert(store, batch.filter(F.col("ordinal") % 10 == part))
    return store


register("m01_truth_table", lambda i: _truth_store(i).read("truth"), f"WITH {_UPSERT} SELECT set_id, bag, page FROM truth UNION ALL SELECT set_id, bag, page FROM o WHERE status = 'inserted'")
register("m01_conflict_table", lambda i: _truth_store(i).read("conflicts"), f"WITH {_UPSERT} SELECT ordinal, set_id, bag, page, held AS existing_page FROM o WHERE status = 'conflict'")


def _replaced(i: Inputs) -> DataFrame:
    store = Store(i.spark, _path(i, "replaced"))
    for part in ("event_id % 3 = 1", "event_id % 3 = 0", "event_id % 3 = 2"):
        stored.replace_latest(store, "examples", _ex(i, part), ["bundle", "candidate_index"], "event_id")
    return store.read("examples")


register("m02_example_table", _replaced, f"SELECT bundle, candidate_index, part_num, qty, event_id FROM ({_EX}) QUALIFY row_number() OVER (PARTITION BY bundle, candidate_index ORDER BY event_id DESC) = 1")


def _bundle_table(i: Inputs) -> DataFrame:
    store = Store(i.spark, _path(i, "bundles"))
    named = lambda head: i.bundles.select(F.col("doc_id").alias("bundle_id"), F.concat(F.lit(head), "doc_id").alias("path"), "status")
    store.write({"bundles": named("old/").filter("bundle_id % 3 <> 0")})
    stored.bundle_upsert(store, named("new/").filter("bundle_id % 2 = 0").drop("status"))
    return store.read("bundles")


register("m03_bundle_table", _bundle_table, "SELECT doc_id AS bundle_id, CASE WHEN doc_id % 2 = 0 THEN concat('new/', doc_id) ELSE concat('old/', doc_id) END AS path, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE coalesce(status, 'pending') END AS status FROM bundles WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")


def _catalog_files(i: Inputs) -> str:
    """The parts as SQLite files in the shared folder, one written by each task."""
    path = _path(i, "sqlite").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/{uuid4().hex}.part"
        with sqlite3.connect(draft) as con:
            con.execute("CREATE TABLE parts (part_num INTEGER, name TEXT COLLATE NOCASE, size INT, price REAL)")
            for batch in batches:
                con.executemany("INSERT INTO parts VALUES (?, ?, ?, ?)", zip(*(c.to_pylist() for c in batch.columns)))
        con.close()
        yield pa.RecordBatch.from_arrays([pa.array([draft])], ["draft"])

    rows = i.part.selectExpr("cast(p_partkey AS bigint)", "p_name", "cast(p_size AS int)", "cast(p_retailprice AS double)").repartition(4)
    for r in rows.mapInArrow(write, "draft string").collect():  # files of the tasks that count; a lost one's draft is never named .db
        os.rename(r["draft"], r["draft"].replace(".part", ".db"))
    return path


register(
    "s03_catalog_sqlite", lambda i: sqlite.sqlite_table(i.spark, _catalog_files(i), "parts", "part_num long, name string, size int", 500).filter("size >= 20 AND (name > 'b' OR size = 30)"),
    "SELECT p_partkey AS part_num, p_name AS name, p_size AS size FROM part WHERE p_size >= 20 AND (p_name > 'b' OR p_size = 30)",
)

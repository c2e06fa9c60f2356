"""Streaming operators against their batch meaning, sources and sinks, and image jobs on small images."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from stepweave.operators import images, sequences
from stepweave.sources import files
from stepweave.streaming import incremental


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def collected(spark, stream, tmp_path, name):
    drain(stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start())
    return spark.read.parquet(str(tmp_path / name))


def test_reset_stream(spark, tmp_path):
    kinds = "set_id long, page int, value int, ts timestamp"
    rows = lambda *r: spark.createDataFrame(r, "set_id long, page int, value int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    # page 2 comes in two batches and after page 3; page 9 has two steps; page 4 is over the limit
    for part in (rows((1, 1, 5, 60), (1, 3, 1, 180), (2, 1, 12, 60)), rows((1, 2, 30, 120), (1, 2, 3, 125), (1, 4, 900, 240), (1, 9, 1, 540), (1, 9, 30, 541)), rows((2, 2, 1, 120), (1, 10, 1, 600)), rows((0, 1, 1, 9_000_000)), rows((1, 5, 7, 300), (0, 2, 1, 9_000_001)), rows((0, 3, 1, 99_000_000)), rows((0, 4, 1, 99_000_001))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        got = collected(spark, incremental.reset_stream(stream), tmp_path, "out")
    got = sorted((r["set_id"], r["page"], r["low"], r["high"], r["previous"], r["bag_start"]) for r in got.filter("not late and set_id > 0").collect())
    assert got == [(1, 1, 5, 5, None, False), (1, 2, 3, 30, 5, False), (1, 3, 1, 1, 30, True), (1, 4, 900, 900, 1, False), (1, 9, 1, 30, 1, False), (1, 10, 1, 1, 30, True), (2, 1, 12, 12, None, False), (2, 2, 1, 1, 12, True)]


def test_incremental_scan_is_w18(spark, tmp_path):
    rows = [(1, 5, 1), (1, 9, 3), (1, 12, 2), (1, 20, 3), (1, 21, 2), (2, 4, 2), (2, 6, 1)]
    for lo, hi in ((0, 9), (9, 13), (9, 13), (13, 99)):  # one chunk is sent again
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi] or rows[:0], "set_id long, page int, bag int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = collected(spark, incremental.incremental_scan(spark.readStream.schema("set_id long, page int, bag int").parquet(str(tmp_path / "in"))), tmp_path, "out")
    whole = sequences.consecutive_accept(spark.createDataFrame(rows, "set_id long, page int, bag int"))
    seen = got.filter("reason <> 'behind the cursor'").select("set_id", "page", "bag", "accepted", "reason")
    assert sorted(map(tuple, seen.collect())) == sorted((r["set_id"], r["page"], r["bag"], r["accepted"], r["reason"]) for r in whole.collect())
    assert got.filter("reason = 'behind the cursor'").count() == 2


def test_truth_conflict_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 10, 2), (1, 1, 12, 3), (1, 2, 20, 4)], "set_id long, bag int, page int, ordinal long").coalesce(1)
    got = collected(spark, incremental.truth_conflicts(written(spark, rows, tmp_path / "in")), tmp_path, "out")
    assert sorted((r["bag"], r["page"], r["status"], r["existing_page"]) for r in got.collect()) == [(1, 10, "exists", None), (1, 10, "inserted", None), (1, 12, "conflict", 10), (2, 20, "inserted", None)]


def test_truth_stream_writes_conflicts_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 12, 3), (1, 2, 20, 4)], "set_id long, bag int, page int, ordinal long").coalesce(1)
    drain(incremental.truth_stream(written(spark, rows, tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "k")))
    assert sorted((r["bag"], r["page"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 10), (2, 20)]
    assert [(r["page"], r["existing_page"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [(12, 10)]


def test_review_events_fold(spark, tmp_path):
    events = lambda *r: spark.createDataFrame(r, "crop long, slot int, kind string, label long, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    for part in (events((1, 1, "save", 7, 1), (1, 1, "ignored", None, 2), (1, 1, "save", 8, 3), (1, 1, "save", 8, 3), (2, 1, "save", 5, 1)), events((1, 1, "save", 6, 2), (1, 1, "unknown", None, 9)), events((3, 1, "ignored", None, 4))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        drain(incremental.review_events(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "c"), buckets=4))
    assert sorted(tuple(r) for r in incremental.folded(spark, str(tmp_path / "table")).collect()) == [(1, 1, 8, True, False), (2, 1, 5, False, False), (3, 1, None, False, True)]


def png(path, rows):
    """A small 8-bit RGBA file."""
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_page_files(spark, tmp_path):
    blank, red = (0, 0, 0, 0), (250, 10, 20, 255)
    for n in (1, 2):
        png(tmp_path / "s1" / "run1" / f"page_00{n}.png", [[blank, red], [blank, red]])
    png(tmp_path / "s1" / "run1" / "cover.png", [[red]])
    found = files.image_files(spark, str(tmp_path))
    assert sorted(r["page"] for r in files.page_run_latest(found).collect()) == [1, 2] and files.page_index(found).count() == 2
    assert files.latest_artifact(found, r"page_00(\d)\.png$").count() == 2
    pixels = spark.read.format("image").option("pathGlobFilter", "page_001.png").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.col("image.origin").alias("id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    stats = images.foreground_stats(pixels).first()
    assert (stats["pixels"], stats["x"], stats["w"], stats["h"], stats["mean"][:3]) == (2, 1, 1, 2, [20, 10, 250])


def test_image_jobs(spark):
    mask = bytes([9, 9, 0, 0, 0, 0, 9, 0, 0, 0, 0, 9])
    df = spark.createDataFrame([(1, 3, 4, 1, bytearray(mask)), (2, 3, 4, 1, None)], "id long, height int, width int, channels int, data binary")
    found = images.mask_islands(df.filter("id = 1"), least=1).collect()
    assert [(r["area"], r["x"], r["w"], r["h"]) for r in found] == [(4, 0, 4, 3)]
    assert images.layout_signals(df).filter("bright_ratio is null").count() == 1
    assert images.top_band(df).filter("passes").count() == 1
    boxes = spark.createDataFrame([(1, 7, -1, -1, 3, 2), (1, 8, 50, 50, 2, 2)], "id long, crop long, x int, y int, w int, h int")
    assert [(r["crop"], r["height"], r["width"], bytes(r["data"])) for r in images.crop_extract(df, boxes).collect()] == [(7, 1, 2, b"\x09\x09")]


def test_manifests_and_sinks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y", "n": 2}]))
    (tmp_path / "m" / "b.json").write_text(json.dumps({"entries": [{"id": "z", "n": 3}]}))
    rows = files.manifest(spark, str(tmp_path / "m"), "id: string, n: int")
    assert sorted(r["id"] for r in rows.collect()) == ["x", "y", "z"]
    files.json_sink(rows.select("id", "n"), str(tmp_path / "out"), "n")
    assert files.json_table(spark, str(tmp_path / "out")).count() == 3
    files.tsv_sink(rows.select("id", F.array(F.lit("a"), F.lit("b")).alias("flags")), str(tmp_path / "tsv"), "flags")
    assert files.tsv_table(spark, str(tmp_path / "tsv")).filter("flags = 'a|b'").count() == 3
    state = spark.createDataFrame([("s", 1, {"c1": ("good", [1, 2]), "c2": ("open", None)})], "set_num string, bag int, crops map<string, struct<status: string, parts: array<int>>>")
    assert files.review_state(state).count() == 3

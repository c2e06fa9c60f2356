"""Incremental versions of batch operators for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stepweave.operators import state as folds, stored
from stepweave.operators.stored import BUCKETS
from stepweave.sources.versioned import Store
from stepweave.streaming import keyed

BAGS = 64


def windowed_rate(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; the same plan serves batch and stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_rate(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user and their events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def reset_stream(steps: DataFrame, late: str = "10 minutes", least: int = 10, limit: int = 200) -> DataFrame:
    """Resets of a stream of (set_id, page, value, ts), a row for each page as in W03, with the previous maximum as state.

    A page waits, as its lowest and highest step, until the watermark has passed its last row; then pages go in order. Pages with a
    step over ``limit`` don't become the page to compare with. A page that comes when a later one is done already is reported as
    late and changes nothing.
    """
    out = "set_id long, page int, low int, high int, previous int, bag_start boolean, late boolean"
    rows = _on_rocksdb(steps).withWatermark("ts", late).select("set_id", "page", "value", "ts", F.unix_millis("ts").alias("at")).groupBy("set_id")
    return rows.transformWithState(keyed.Resets(least, limit), out, "Append", "EventTime")


def incremental_scan(candidates: DataFrame, first: int = 1, forget_after: int | None = None) -> DataFrame:
    """W18 over chunks of a scan: candidates (set_id, page, bag) in page order, with the expected number and a cursor as state.

    ``expected`` is the number that was due at each candidate; candidates behind the cursor (the next page to read) are
    reported as such and change nothing, so a chunk may be sent again. With ``forget_after`` (milliseconds) a scan that
    has got no chunk for so long begins anew; such a stream looks for what to forget all the time, so it doesn't end by availableNow.
    """
    out = "set_id long, page int, bag int, expected int, accepted boolean, reason string"
    rows = _on_rocksdb(candidates).filter("bag IS NOT NULL").groupBy("set_id")
    return rows.transformWithStateInPandas(keyed.Scan(first, forget_after), out, "Append", "ProcessingTime" if forget_after else "None")


def truth_conflicts(detections: DataFrame) -> DataFrame:
    """Outcome of each detection (set_id, bag, page, ordinal) against the first page its key had.

    BAGS neighbouring bags of a set share a group of the state, as each group costs some calls to the store.
    """
    out = "set_id long, bag int, page int, ordinal long, status string, existing_page int"
    rows = _on_rocksdb(detections).select("set_id", "bag", "page", "ordinal", F.floor(F.col("bag") / BAGS).alias("block"))
    return rows.groupBy("set_id", "block").transformWithState(keyed.Truth(), out, "Append", "None")


def _on_rocksdb(rows: DataFrame) -> DataFrame:
    """Keyed state variables need the RocksDB state store; a session without a choice of its own gets it."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows


def truth_stream(detections: DataFrame, truth: str, conflicts: str, checkpoint: str) -> StreamingQuery:
    """Writes new truth and conflicts to two tables, a folder for each batch, so that a batch run again replaces its own."""

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("status = 'inserted'").select("set_id", "bag", "page").write.mode("overwrite").parquet(f"{truth}/batch={number}")
        batch.filter("status = 'conflict'").write.mode("overwrite").parquet(f"{conflicts}/batch={number}")
        batch.unpersist()

    return truth_conflicts(detections).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory_refresh(confirmations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """New confirmations with their vectors, a join of the stream with a static table."""
    return confirmations.join(embeddings, "element_id")


def review_events(events: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", buckets: int = BUCKETS) -> StreamingQuery:
    """Folds label events (crop, slot, kind, label, ts, seq) into the committed table at ``path``; later events win by sequence.

    Events that are sent again within the watermark are dropped. The table is cut into buckets of crops; a batch replaces the buckets
    it touches alone, in one commit. What is stored takes part in every batch, so a batch that runs again, or a fresh
    checkpoint over an old table, changes nothing that is newer. Versions but the last two are removed.
    """
    columns = ["crop", "slot", "kind", "label", "ts", "seq"]

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "crop", "slot", "kind").agg(F.max_by("label", "seq").alias("label"), F.max("ts").alias("ts"), F.max("seq").alias("seq"))

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        stored.merge_in_buckets(store, "events", batch, F.col("crop"), fold, buckets)
        store.vacuum(keep=2, grace_s=0)  # this stream is the table's only writer

    fresh = events.select(*columns).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["crop", "slot", "kind", "seq"])
    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """Slot states of the table that ``review_events`` wrote."""
    return folds.label_event_fold(Store(spark, path).read("events"))

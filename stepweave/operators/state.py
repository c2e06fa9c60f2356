"""State changes as DataFrame transforms: each takes a state and a batch and returns new states or outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["set_id", "bag"]
# fixed values: the review vocabularies
REVIEW_STATUSES = ("approved", "rejected", "needs_split_fix", "bad_mask", "pending")
FINAL = ("accepted", "rejected")

MAX_PLACES = 4_096


def truth_upsert(truth: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome of each batch row, new truth). Truth and batch: set_id, bag, page; the batch also has ordinal.

    A key's first row is inserted if truth lacks it; the same page exists, another page is a conflict and changes nothing.
    """
    rows = batch.filter("bag IS NOT NULL AND page IS NOT NULL").join(truth.select(*KEY, F.col("page").alias("known")), KEY, "left")
    w = Window.partitionBy(*KEY).orderBy("ordinal")
    first = F.first("page").over(w)
    rows = rows.withColumn("held", F.coalesce("known", first)).withColumn("nth", F.row_number().over(w))
    status = F.when(F.col("known").isNull() & (F.col("nth") == 1), "inserted").when(F.col("held") == F.col("page"), "exists").otherwise("conflict")
    outcome = rows.select("ordinal", *KEY, "page", status.alias("status"), F.when(status == "conflict", F.col("held")).alias("existing_page"))
    return outcome, truth.select(*KEY, "page").unionByName(outcome.filter("status = 'inserted'").select(*KEY, "page"))


def replace_latest(state: DataFrame, batch: DataFrame, keys: list[str], order: str, keep_missing: bool = False) -> DataFrame:
    """Last write wins by ``order``; with ``keep_missing`` a null in a later row keeps the earlier value."""
    rows = state.unionByName(batch)
    values = [c for c in state.columns if c not in (*keys, order)]
    if keep_missing:
        return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values), F.max(order).alias(order))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("best"), F.max(order).alias(order))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in values), order)


def bundle_upsert(index: DataFrame, registered: DataFrame) -> DataFrame:
    """(bundle_id, path, status): paths are overwritten, a status stays; blank or missing is pending."""
    rows = index.select("bundle_id", F.col("path").alias("old"), "status").join(registered.select("bundle_id", F.col("path").alias("new")), "bundle_id", "full")
    return rows.select("bundle_id", F.coalesce("new", "old").alias("path"), F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")).alias("status"))


def review_update(index: DataFrame, reviews: DataFrame, fields: Column | None = None, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(index after the reviews, refused reviews). A review needs a known bundle, a known status and a score of 1..5.

    With ``fields`` (the parsed id) its missing ``columns`` are filled in.
    """
    checked = reviews.join(index.select("bundle_id", F.lit(True).alias("known")), "bundle_id", "left")
    why = F.when(F.col("known").isNull(), "unknown bundle").when(~F.coalesce(F.col("new_status").isin(*REVIEW_STATUSES), F.lit(False)), "unknown status").when(~F.coalesce(F.col("score").between(1, 5), F.lit(False)), "score out of range")
    checked = checked.withColumn("why", why)
    good = checked.filter("why IS NULL").groupBy("bundle_id").agg(F.max_by(F.struct("new_status", "score"), "seq").alias("r"))
    after = index.join(good, "bundle_id", "left").select("bundle_id", F.coalesce("r.new_status", "status").alias("status"), F.col("r.score").alias("score"), *columns)
    if fields is not None:
        after = id_backfill(after, fields, list(columns))
    return after, checked.filter("why IS NOT NULL").select("bundle_id", "new_status", "score", "why")


def id_backfill(rows: DataFrame, fields: Column, columns: list[str]) -> DataFrame:
    """Missing columns from the parsed id."""
    return rows.withColumn("_f", fields).select(*(F.coalesce(c, F.col(f"_f.{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def example_delete(examples: DataFrame, prefixes: DataFrame, like_compat: bool = False) -> DataFrame:
    """Examples whose id starts with none of ``prefixes`` (prefix). With ``like_compat`` ``_`` stands for any character.

    An id meets the prefixes by an equi join on the part of itself that a prefix says literally: all of it, or with ``like_compat`` its
    first run without ``_``; what meets is then compared whole. The driver holds the distinct places of such parts (start and length), at most
    MAX_PLACES: beyond that lengths are cut to powers of two, which only lets more meet. Null ids stay, null prefixes count for nothing.
    """
    run = F.regexp_extract("prefix", "^(_*)([^_]*)", 2) if like_compat else F.col("prefix")
    start = F.length(F.regexp_extract("prefix", "^(_*)([^_]*)", 1)) if like_compat else F.lit(0)
    named = prefixes.filter("prefix IS NOT NULL").select("prefix").distinct().select("prefix", start.alias("at"), run.alias("part"))
    ids = examples.filter("example_id IS NOT NULL").select("example_id").distinct()
    free = named.filter("part = ''").agg(F.min(F.length("prefix")).alias("n")).first()["n"]  # of these only the length counts
    named = named.filter("part <> ''")
    places = named.select("at", F.length("part").alias("n")).distinct().limit(MAX_PLACES + 1).collect()
    if len(places) > MAX_PLACES:
        named = named.withColumn("part", F.expr("substring(part, 1, cast(shiftleft(1, cast(floor(log2(length(part))) AS int)) AS int))"))
        places = named.select("at", F.length("part").alias("n")).distinct().collect()
    by_place = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for at, n in places)) if places else F.array().cast("array<struct<at:int,n:int>>")
    parts = ids.select("example_id", F.explode(F.filter(by_place, lambda p: p["at"] + p["n"] <= F.length("example_id"))).alias("p")).select("example_id", F.col("p.at").alias("at"), F.expr("substring(example_id, p.at + 1, p.n)").alias("part"))
    same = lambda m, c: F.when(m == "_", m).otherwise(c) if like_compat else c
    begins = (F.length("prefix") <= F.length("example_id")) & (F.array_join(F.zip_with(F.split("prefix", ""), F.split(F.expr("substring(example_id, 1, length(prefix))"), ""), same), "") == F.col("prefix"))
    gone = parts.join(named, ["at", "part"]).filter(begins).select("example_id")
    if free is not None:
        gone = gone.union(ids.filter(F.length("example_id") >= free))
    return examples.join(gone.distinct(), "example_id", "left_anti")


def nested_update(candidates: str, index: Column, status: Column) -> Column:
    """array<struct<index, status>> with the status of the entry whose index matches; by position if none does."""
    arr = F.col(candidates)
    named = F.exists(arr, lambda x: x["index"] == index)
    return F.transform(arr, lambda x, i: F.when(F.when(named, x["index"] == index).otherwise(i == index), x.withField("status", status)).otherwise(x))


def nested_updates(rows: DataFrame, arrays: list[str], index: Column, status: Column) -> DataFrame:
    """``nested_update`` in each of the candidate arrays that ``rows`` has; a null array stays null."""
    return rows.withColumns({c: nested_update(c, index, status) for c in arrays if c in rows.columns})


def auto_promote(status: Column, candidates: Column) -> Column:
    """Approved once all candidates are final and there is one; approved and rejected stay."""
    done = (F.size(candidates) > 0) & F.forall(candidates, lambda x: x["status"].isin(*FINAL))
    return F.when(F.coalesce(status, F.lit("")).isin("approved", "rejected"), status).when(done, "approved").otherwise(status)


def label_event_fold(events: DataFrame) -> DataFrame:
    """Slot state from its events (crop, slot, seq, kind, label): the last saved label and the last event's flag.

    A save clears both flags; unknown and ignored clear each other and keep the label. Order of arrival doesn't matter.
    """
    saved = F.when(F.col("kind") == "save", F.col("seq"))
    rows = events.groupBy("crop", "slot").agg(F.max_by("label", saved).alias("label"), F.max_by("kind", "seq").alias("last"))
    return rows.select("crop", "slot", "label", (F.col("last") == "unknown").alias("unknown"), (F.col("last") == "ignored").alias("ignored"))


def slot_status(label: Column, unknown: Column, ignored: Column) -> Column:
    """Ignored before unknown before confirmed before needs_review."""
    return F.when(ignored, "ignored").when(unknown, "unknown").when(label.isNotNull(), "confirmed").otherwise("needs_review")


def review_progress(slots: DataFrame, exclusive: bool = True) -> DataFrame:
    """Counts and percent of each crop; exclusive statuses, or flags that may overlap."""
    if exclusive:
        s = slot_status(F.col("label"), F.col("unknown"), F.col("ignored"))
        parts = {k: F.count_if(s == k) for k in ("confirmed", "unknown", "ignored")}
    else:
        parts = {"confirmed": F.count_if(F.col("label").isNotNull()), "unknown": F.count_if("unknown"), "ignored": F.count_if("ignored")}
    rows = slots.groupBy("crop").agg(F.count("*").alias("total"), *(v.alias(k) for k, v in parts.items()))
    done = F.col("confirmed") + F.col("unknown") + F.col("ignored")
    return rows.withColumn("needs_review", F.greatest(F.col("total") - done, F.lit(0))).withColumn("percent", F.bround(100 * done / F.col("total"), 0).cast("int"))


def next_unreviewed(slots: DataFrame) -> DataFrame:
    """For each open or done slot the next open one: later in its crop, then from the crop's start, then any later crop, then the first."""
    status = slot_status(F.col("label"), F.col("unknown"), F.col("ignored"))
    open_slot = F.when(status == "needs_review", F.struct("crop", "slot"))
    rows = slots.withColumn("open", open_slot)
    later = Window.partitionBy("crop").orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    head = Window.partitionBy("crop").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.filter("open IS NOT NULL").groupBy("crop").agg(F.min("open").alias("first"))
    top = firsts.agg(F.min("first").alias("top"))
    after = _next_crop(rows.select("crop").distinct(), firsts)
    out = rows.withColumn("here", F.coalesce(F.first("open", ignorenulls=True).over(later), F.first("open", ignorenulls=True).over(head)))
    out = out.join(after, "crop", "left").join(F.broadcast(top))
    found = F.coalesce("here", "after", F.when(F.col("top.crop") != F.col("crop"), F.col("top")))
    return out.select("crop", "slot", found["crop"].alias("next_crop"), found["slot"].alias("next_slot"))


def _next_crop(crops: DataFrame, firsts: DataFrame, span: int = 4096, levels: int = 3) -> DataFrame:
    """(crop, after): first open slot of the next crop that has one.

    Crops go by ranges of ids, ranges by ranges of ranges and so on, each chained by its members' firsts; the ranges of the last
    level, one for span ** levels ids, are chained together.
    """

    def chained(rows: DataFrame, level: int) -> DataFrame:
        """(id, after) of rows (id, first)."""
        later = lambda w: F.first("first", ignorenulls=True).over(w.orderBy("id").rowsBetween(1, Window.unboundedFollowing))
        if level == levels:
            return rows.select("id", later(Window.partitionBy(F.lit(0))).alias("after"))
        rows = rows.withColumn("range", F.expr(f"floor(id / {span})"))
        beyond = chained(rows.groupBy("range").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("id"))).alias("first")).withColumnRenamed("range", "id"), level + 1)
        inside = rows.withColumn("inside", later(Window.partitionBy("range")))
        return inside.join(beyond.select(F.col("id").alias("range"), F.col("after").alias("beyond")), "range").select("id", F.coalesce("inside", "beyond").alias("after"))

    marks = crops.join(firsts, "crop", "left").select(F.col("crop").alias("id"), "first")
    return chained(marks, 0).withColumnRenamed("id", "crop")


def rekey(rows: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with new keys, problems). Corrections: key, new_key; missing sources and duplicate results are problems."""
    out = rows.join(corrections, "key", "left").withColumn("key", F.coalesce("new_key", "key")).drop("new_key")
    missing = corrections.join(rows, "key", "left_anti").select("key", F.lit("missing source").alias("problem"))
    twice = out.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("duplicate key").alias("problem"))
    return out, missing.union(twice)


def promote_recovered(rows: DataFrame, recovered: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered rows for absent keys are added, excluded keys dropped, nothing is overwritten."""
    fresh = recovered.join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(fresh).join(excluded.select(*keys), keys, "left_anti")


def best_per_key(candidates: DataFrame) -> DataFrame:
    """Per section the highest confidence, then the lowest page; the rest is marked as discarded."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "page")
    return candidates.withColumn("discarded", F.row_number().over(w) > 1)


def auto_confirm(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """The best candidates, confirmed unless truth has another page."""
    best = best_per_key(candidates).filter("NOT discarded").drop("discarded")
    rows = best.join(truth.select(*KEY, F.col("page").alias("existing_page")), KEY, "left")
    return rows.withColumn("outcome", F.when(F.col("existing_page") != F.col("page"), "skipped").otherwise("confirmed"))


def bundle_register(entries: DataFrame, new: DataFrame) -> DataFrame:
    """An entry is replaced by its new one, keeping the earlier review and cloud fields where the new one has none."""
    old = entries.select("bundle_id", *(F.col(c).alias(f"o_{c}") for c in ("path", "review", "cloud")))
    rows = new.join(old, "bundle_id", "full")
    return rows.select("bundle_id", F.coalesce("path", "o_path").alias("path"), F.coalesce("review", "o_review").alias("review"), F.coalesce("cloud", "o_cloud").alias("cloud"))


def truth_split(starts: DataFrame, truth: DataFrame) -> DataFrame:
    """A start on a new page is saved, on a page with its own number kept, with another number skipped."""
    known = truth.groupBy("set_id", "page").agg(F.min("bag").alias("existing_bag"))
    rows = starts.join(known, ["set_id", "page"], "left")
    return rows.withColumn("outcome", F.when(F.col("existing_bag").isNull(), "save").when(F.col("existing_bag") == F.col("bag"), "keep").otherwise("same_page_different_bag_already_saved"))


def review_stats(bundles: DataFrame) -> DataFrame:
    """Bundles by status; null is pending, unknown statuses are counted nowhere."""
    s = F.coalesce("status", F.lit("pending"))
    return bundles.agg(*(F.count_if(s == k).alias(k) for k in REVIEW_STATUSES))


def preserve_review(windows: DataFrame, previous: DataFrame) -> DataFrame:
    """New windows keep the human fields of an accepted or rejected predecessor."""
    old = previous.filter(F.col("status").isin("accepted", "rejected")).select(*KEY, F.col("status").alias("o_status"), F.col("note").alias("o_note"))
    rows = windows.join(old, KEY, "left")
    return rows.select(*KEY, "page", F.coalesce("o_status", "status").alias("status"), F.when(F.col("o_status").isNotNull(), F.col("o_note")).otherwise(F.col("note")).alias("note"))


def truth_map(truth: DataFrame) -> DataFrame:
    """Sorted distinct pages of each number, and the first."""
    return truth.groupBy(*KEY).agg(F.sort_array(F.collect_set("page")).alias("pages"), F.min("page").alias("first_page"))


def gap_merge(inferred: DataFrame, extra: DataFrame) -> DataFrame:
    """Inferred gaps, and those of ``extra`` whose (set, page, step) is new."""
    return inferred.unionByName(extra.join(inferred, ["set_id", "page", "step"], "left_anti"))

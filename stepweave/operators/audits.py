"""Worklists, record resolution, label precedence, unions and samples of the review process."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.operators.grouped import fold_groups

SET = "set_id"


def review_queue(bundles: DataFrame, status: str | None = None, source: str | None = None, set_num: str | None = None, bag: int | None = None, limit: int = 50) -> DataFrame:
    """The oldest bundles by optional status, source, set and section; the report's limit is kept within 1..500."""
    rows = bundles
    if status is not None:
        rows = rows.filter(F.coalesce("status", F.lit("pending")) == status)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if set_num is not None:
        rows = rows.filter(F.col("set_num") == set_num)
    if bag is not None:
        rows = rows.filter(F.col("bag") == bag)
    return rows.orderBy("created_at", "bundle_id").limit(max(1, min(int(limit), 500)))


def trusted_anchor_guard(visual: DataFrame, trusted: DataFrame) -> DataFrame:
    """Where a page has trusted steps, a visual number is dropped as duplicate or as non-sequential."""
    known = trusted.groupBy(SET, "page").agg(F.collect_set("value").alias("known"))
    rows = visual.join(known, [SET, "page"], "left")
    why = F.when(F.col("known").isNull(), F.lit(None)).when(F.array_contains("known", F.col("value")), "duplicate").otherwise("non_sequential")
    return rows.select(SET, "page", F.when(why.isNull(), F.col("value")).alias("value"), why.alias("reason"))


def crop_required(label: Column, anchor: Column, box: Column) -> Column:
    """No for a false or empty label or without an anchor; yes for a real label; else yes if the proposal has a box."""
    return F.when(label.isin("FALSE_STEP", "EMPTY_STEP") | ~F.coalesce(anchor, F.lit(False)), False).when(label.isNotNull(), True).otherwise(F.coalesce(box, F.lit(False)))


def callout_visibility(proposed: Column, probed: Column) -> Column:
    """``visible`` with a proposed or probed box, ``hidden`` where a probe found none, else ``unknown``."""
    return F.when(F.coalesce(proposed, F.lit(False)) | F.coalesce(probed, F.lit(False)), "visible").when(probed.isNotNull(), "hidden").otherwise("unknown")


def good_label_queries(crops: DataFrame) -> DataFrame:
    """Good crops with a part; the first part is the expected label."""
    return crops.filter((F.col("status") == "good") & (F.size("parts") > 0)).select("crop", F.get("parts", F.lit(0)).alias("expected"))


def mask_worklist(items: DataFrame, masks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items without a mask, without a verdict or with a failed one; verdicts of vanished items don't count."""
    rows = items.select("item").join(masks.select("item", F.lit(True).alias("mask")).distinct(), "item", "left").join(verdicts.select("item", "verdict"), "item", "left")
    why = F.when(F.col("mask").isNull(), "no mask").when(F.col("verdict").isNull(), "no verdict").when(F.col("verdict") == "fail", "failed")
    return rows.select("item", why.alias("why")).filter("why IS NOT NULL")


def review_counts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Totals against active verdicts."""
    rows = items.select("item").join(verdicts.select("item", "verdict"), "item", "left")
    return rows.agg(F.count("*").alias("total"), F.count("verdict").alias("reviewed"), F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if(F.col("verdict") == "fail").alias("failed"))


def phase(items: DataFrame, masks: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """One state for each section: masks to make, then reviews to do, then failures to redo, then ready."""
    rows = items.select(key, "item").join(mask_worklist(items, masks, verdicts), "item", "left")
    n = lambda w: F.count_if(F.col("why") == w)
    agg = rows.groupBy(key).agg(n("no mask").alias("m"), n("no verdict").alias("v"), n("failed").alias("f"))
    return agg.select(key, F.when(F.col("m") > 0, "generate_masks").when(F.col("v") > 0, "review_pending").when(F.col("f") > 0, "review_required").otherwise("ready_to_commit").alias("phase"))


def rejected_only(audit: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Audit rows that never were accepted; nulls of a key are equal."""
    right = accepted.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return audit.join(right, match, "left_anti")


def multi_key_resolve(crops: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry of each crop by its id, else the only one of its page and step, else one within 8 pixels, else the first of its page and step.

    Crops: crop_id, page, step, x, y. Entries: entry, crop_id, page, step, x, y.
    """
    e = entries.select("entry", *(F.col(c).alias(f"e_{c}") for c in ("crop_id", "page", "step", "x", "y")))
    e = e.withColumn("alone", F.count("*").over(Window.partitionBy("e_page", "e_step")) == 1)
    by_id = crops.join(e, F.col("crop_id") == F.col("e_crop_id")).select("crop_id", "entry", F.lit(1).alias("rule"))
    near = (F.abs(F.col("x") - F.col("e_x")) <= 8) & (F.abs(F.col("y") - F.col("e_y")) <= 8)
    by_step = crops.join(e, (F.col("page") == F.col("e_page")) & (F.col("step") == F.col("e_step"))).select("crop_id", "entry", F.when(F.col("alone"), 2).when(near, 3).otherwise(4).alias("rule"))
    best = by_id.union(by_step).groupBy("crop_id").agg(F.min(F.struct("rule", "entry")).alias("b"))
    return crops.select("crop_id").join(best, "crop_id", "left").select("crop_id", "b.entry", F.coalesce("b.rule", F.lit(0)).alias("rule"))


def manual_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Forced labels replace automatic ones; rows without an override keep theirs."""
    return rows.join(overrides.select("key", "force"), "key", "left").select("key", F.coalesce("force", "label").alias("label"), F.col("force").isNotNull().alias("forced"))


def backfill_outer(primary: DataFrame, labels: DataFrame, low: int, high: int) -> DataFrame:
    """Primary crops, and labels absent from them whose page lies in the range."""
    extra = labels.filter(F.col("page").between(low, high)).join(primary.select("crop_id"), "crop_id", "left_anti")
    return primary.select("crop_id", "page", F.lit("primary").alias("source")).unionByName(extra.select("crop_id", "page", F.lit("label").alias("source")))


def link_or_create(detected: DataFrame, crops: DataFrame) -> DataFrame:
    """A detected step links to the first crop of its page and value, or becomes a candidate."""
    have = crops.groupBy(SET, "page", "value").agg(F.min("crop").alias("crop"))
    rows = detected.join(have, [SET, "page", "value"], "left")
    return rows.select(SET, "page", "value", "crop", F.when(F.col("crop").isNull(), "create").otherwise("link").alias("action"))


def label_precedence(steps: DataFrame, preset: DataFrame, earlier: DataFrame, proposals: DataFrame) -> DataFrame:
    """Preset label, else a person's earlier one, else none if there is a proposal, else EMPTY_STEP."""
    rows = steps.join(preset.select("key", F.col("label").alias("p")), "key", "left").join(earlier.select("key", F.col("label").alias("h")), "key", "left").join(proposals.select("key", F.lit(True).alias("has")).distinct(), "key", "left")
    return rows.select("key", F.when(F.coalesce("p", "h").isNotNull(), F.coalesce("p", "h")).when(F.col("has").isNull(), "EMPTY_STEP").alias("label"))


def valid_steps(crops: DataFrame, primary: DataFrame, inferred: DataFrame) -> DataFrame:
    """Steps of each page from crops, else from detections of two components or more, else inferred."""
    rows = crops.select(SET, "page", "value", F.lit(1).alias("rank")).unionByName(primary.filter("components >= 2").select(SET, "page", "value", F.lit(2).alias("rank"))).unionByName(inferred.select(SET, "page", "value", F.lit(3).alias("rank")))
    best = rows.withColumn("best", F.min("rank").over(Window.partitionBy(SET, "page")))
    return best.filter("rank = best").select(SET, "page", "value", "rank").distinct()


def cluster_confidence(members: DataFrame) -> DataFrame:
    """Mean score of each cluster, .05 more with two or more members, 1 at most, to 4 places."""
    mean = F.avg("score") + F.when(F.count("*") >= 2, 0.05).otherwise(0.0)
    return members.groupBy(SET, "cluster").agg(F.bround(F.when(F.count("*") >= 2, F.least(F.lit(1.0), mean)).otherwise(mean) + 1e-9, 4).alias("confidence"))


def review_surface(detected: DataFrame, missing: DataFrame, gaps: DataFrame, suppressed: DataFrame) -> DataFrame:
    """How many of each kind remain after suppression."""
    left = lambda df, k: df.select(SET, "page", "value").join(suppressed, [SET, "page", "value"], "left_anti").select(F.lit(k).alias("kind"))
    return left(detected, "detected").union(left(missing, "completeness")).union(left(gaps, "gap")).groupBy("kind").agg(F.count("*").alias("n"))


def fuzzy_rank(candidates: DataFrame, near: float = 5.0) -> DataFrame:
    """Excluded last; scores closer than ``near`` tie and the smaller page goes first. The comparator isn't transitive, so the input order is fixed to page."""

    def compare(a: dict, b: dict) -> int:
        if a["excluded"] != b["excluded"]:
            return 1 if a["excluded"] else -1
        if abs(a["score"] - b["score"]) < near:
            return -1 if a["page"] < b["page"] else 1
        return -1 if a["score"] > b["score"] else 1

    def rank(rows: Iterator[dict]) -> list[dict]:
        return [{**r, "rank": k} for k, r in enumerate(sorted(rows, key=cmp_to_key(compare)), 1)]

    lean = candidates.select(SET, "page", "score", "excluded")
    return fold_groups(lean, SET, ["page"], rank, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema) + ", rank int")


def audit_sample(rows: DataFrame, key: str, score: str, n: int = 10, seed: int = 20260602) -> DataFrame:
    """The ``n`` highest, the ``n`` lowest and ``n`` seeded others."""
    high = rows.orderBy(F.desc(score), key).limit(n).withColumn("bucket", F.lit("high"))
    low = rows.join(high.select(key), key, "left_anti").orderBy(score, key).limit(n).withColumn("bucket", F.lit("low"))
    rest = rows.join(high.select(key).union(low.select(key)), key, "left_anti").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).withColumn("bucket", F.lit("random"))
    return high.unionByName(low).unionByName(rest)


def detection_union(**sources: DataFrame) -> DataFrame:
    """Detections of several sources as one typed set."""
    out = None
    for name, df in sources.items():
        part = df.select(SET, "page", "value", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def merge_sources(detections: DataFrame, suppressed: DataFrame, box: str | None = None, order: str = "source") -> DataFrame:
    """One row for each page and step with its sources; suppressed keys are left out.

    With ``box`` (a struct with w and h) also the first box by ``order`` that isn't empty.
    """
    rows = detections.join(suppressed, [SET, "page", "value"], "left_anti")
    found = [F.sort_array(F.collect_set("source")).alias("sources")]
    if box is not None:
        found.append(F.min_by(box, F.when((F.col(box)["w"] > 0) & (F.col(box)["h"] > 0), F.col(order))).alias(box))
    return rows.groupBy(SET, "page", "value").agg(*found)


def noise_except(checks: DataFrame) -> DataFrame:
    """Keys that failed at least once and never passed."""
    return checks.groupBy(SET, "page").agg(F.bool_or("passed").alias("ever")).filter("NOT ever").select(SET, "page")


def suppressed_union(*sets: DataFrame) -> DataFrame:
    """Distinct keys of misread, sub-step and noise."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def candidate_distinct(rows: DataFrame) -> DataFrame:
    """The first row by ordinal of each part, colour and element."""
    keys = ["part_num", "color_id", *(["element_id"] if "element_id" in rows.columns else [])]
    best = rows.groupBy(*keys).agg(F.min(F.struct("ordinal", "qty")).alias("b"))
    return best.select(*keys, "b.ordinal", "b.qty")


def display_text(label: Column, unknown: Column, ignored: Column, qty: Column) -> Column:
    """text of a slot by its state."""
    return F.when(ignored, "ignored").when(unknown, "unknown").when(label.isNotNull(), F.concat_ws(" ", label.cast("string"), F.concat(qty.cast("string"), F.lit("x")))).otherwise("open")


def audit_paths(crop_path: Column) -> tuple[Column, Column]:
    """overlay path and url of a crop image."""
    return F.regexp_replace(crop_path, r"\.png$", "_overlay.png"), F.concat(F.lit("/images/"), F.regexp_extract(crop_path, "[^/]+$", 0))


def priority_anchors(truth: DataFrame, corrections: DataFrame, clusters: DataFrame) -> DataFrame:
    """Truth; then corrections whose number and page are free; sets without truth number their clusters on from there."""
    fixed = corrections.join(truth, [SET, "bag"], "left_anti").join(truth.select(SET, "page"), [SET, "page"], "left_anti")
    anchors = truth.select(SET, "bag", "page", F.lit("truth").alias("source")).unionByName(fixed.select(SET, "bag", "page", F.lit("correction").alias("source")))
    free = clusters.join(truth.select(SET).distinct(), SET, "left_anti")
    tops = fixed.groupBy(SET).agg(F.max("bag").alias("top"))
    numbered = free.withColumn("nth", F.row_number().over(Window.partitionBy(SET).orderBy("page"))).join(tops, SET, "left")
    return anchors.unionByName(numbered.select(SET, (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("bag"), "page", F.lit("cluster").alias("source")))


def same_page_extension(primary: DataFrame, candidates: DataFrame, reach: int = 6) -> DataFrame:
    """Candidates max+1, max+2, ... of a page up to ``reach``, until the first hole."""
    top = primary.groupBy(SET, "page").agg(F.max("value").alias("top"))
    rows = candidates.select(SET, "page", "value").distinct().join(top, [SET, "page"]).filter((F.col("value") > F.col("top")) & (F.col("value") <= F.col("top") + reach))
    nth = F.row_number().over(Window.partitionBy(SET, "page").orderBy("value"))
    return rows.withColumn("nth", nth).filter("value - top = nth").select(SET, "page", "value")


def bootstrap_start(steps: DataFrame, front: int = 5) -> DataFrame:
    """A set starts one page before its earliest step 1 after the front matter, else before its first page with steps there."""
    after = steps.filter(F.col("page") > front)
    return after.groupBy(SET).agg((F.coalesce(F.min(F.when(F.col("value") == 1, F.col("page"))), F.min("page")) - 1).alias("start"))

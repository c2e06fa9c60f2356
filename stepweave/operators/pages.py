"""Page classification, window scoring and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.operators.acceptance import runs_asof

SET = "set_id"


def page_kind(signals: DataFrame) -> DataFrame:
    """Cover, intro or legal, parts page or other, in that order, from word, line, number, brightness, edge and box signals."""
    c = F.col
    cover = (c("page") <= 2) & (c("words") <= 20) & (c("lines") <= 8) & (c("bright") < 0.30) & (c("edges") >= 0.06)
    heavy = (c("words") >= 35) | (c("lines") >= 9) | ((c("words") >= 24) & (c("lines") >= 6)) | ((c("words") >= 22) & (c("long_words") >= 12))
    many = (c("numbers") >= 20) | ((c("numbers") >= 12) & (c("boxes") >= 8)) | ((c("numbers") >= 10) & (c("lines") >= 10) & (c("boxes") >= 6))
    kind = F.when(cover, "cover_page").when(heavy & (c("largest_box") < 0.35), "intro_or_legal").when(many & (c("largest_box") < 0.20), "parts_page").otherwise("other")
    return signals.withColumn("kind", kind)


def page_kind_scan(pages: DataFrame, only_other: bool = True) -> DataFrame:
    """P20: kinds of a set's pages, on request only the unclassified ones."""
    rows = page_kind(pages)
    return rows.filter("kind = 'other'") if only_other else rows


def normalize_page_row(rows: DataFrame) -> DataFrame:
    """Missing flags are false, missing confidence 0, strong structure needs panel, shell and grey bag."""
    flags = ("panel", "shell", "grey", "number", "overview")
    out = rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags} | {"confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))})
    return out.withColumn("strong", F.col("panel") & F.col("shell") & F.col("grey"))


def shortlist(rows: DataFrame, limit: int = 40) -> DataFrame:
    """Confident rows that saw a number or a grey bag and know their number, are surer, or have panel and number; the report's first ``limit``."""
    good = (F.col("confidence") >= 0.5) & (F.col("number") | F.col("grey")) & (F.col("bag").isNotNull() | (F.col("confidence") >= 0.6) | (F.col("panel") & F.col("number")))
    return rows.filter(good).orderBy(F.desc("confidence"), SET, "page").limit(limit)


def strong_candidates(rows: DataFrame) -> DataFrame:
    """Grey bag, number, confidence of .85 or more and a positive number."""
    return rows.filter(F.col("grey") & F.col("number") & (F.col("confidence") >= 0.85) & (F.col("bag") > 0))


def scan_order(rows: DataFrame) -> DataFrame:
    """Seven keys, mixed directions, nulls last."""
    return rows.orderBy(F.desc("strong"), F.desc("number"), F.desc("grey"), F.desc("panel"), F.desc_nulls_last("confidence"), F.asc_nulls_last("bag"), SET, "page")


def window_score(c: str = "") -> tuple[Column, Column]:
    """(score, reasons) of a page as start of section ``bag`` in the window [start, end].

    Columns: page, bag, start, end, detected, number, panel, shell, grey, strong, overview (booleans), confidence, kind, green.
    """
    col = lambda n: F.col(c + n)
    weak = col("number") & ~col("strong") & ~col("shell") & ~col("grey")
    exact, other = col("detected") == col("bag"), col("detected").isNotNull() & (col("detected") != col("bag"))
    span = F.greatest(F.lit(1), col("end") - col("start"))
    early = 1.0 - F.greatest(F.lit(0), col("page") - col("start")) / span
    plain = (col("kind") == "other") & ~col("number") & ~col("strong") & col("detected").isNull()
    # fixed values: points and reasons of each sign, and the limits they are tied to
    terms = [
        (col("number"), 40.0, "+ number_box_found"), (~col("number"), -16.0, "- no_number_detected"),
        (exact & weak, 12.0, "+ exact_bag_number_match_weak"), (exact & ~weak, 85.0, "+ exact_bag_number_match"), (col("detected").isNull(), -10.0, "- no_bag_number"),
        (col("panel"), 18.0, "+ panel_found"), (~col("panel"), -8.0, "- no_panel"), (col("shell"), 10.0, "+ shell_found"), (col("grey"), 12.0, "+ grey_bag_found"),
        (col("strong"), 12.0, "+ strong_structure"), (~col("strong"), -12.0, "- weak_structure"), (col("confidence") >= 0.75, 0.0, "+ high_confidence"), (col("confidence") <= 0.30, -14.0, "- low_confidence"),
        (early >= 0.66, 0.0, "+ near_window_start"), (early <= 0.20, -8.0, "- late_in_window"), (col("overview"), -22.0, "- overview_like_page"), (col("kind") != "other", -18.0, "- precheck_page_kind"),
        (weak, -150.0, "- no_bag_structure_number_only"), (col("green") >= 4, -90.0, "- multi_step_green_boxes"), ((col("green") >= 2) & (col("green") < 4), -55.0, "- multi_step_green_boxes"), (plain, -15.0, "- looks_like_normal_instruction_page"),
    ]
    score = sum((F.when(when, points).otherwise(0.0) for when, points, _ in terms), F.lit(0.0)) + col("confidence") * 35.0 + early * 14.0
    score = score + F.when(other, -25.0 - F.least(F.lit(30.0), F.abs(col("detected") - col("bag")) * 8.0)).otherwise(0.0)
    reasons = F.array_compact(F.array(*(F.when(when, F.lit(why)) for when, _, why in terms), F.when(other, F.lit("- conflicting_bag_number"))))
    return F.bround(score + 1e-9, 3), reasons


def gap_window_scan(windows: DataFrame, pages: DataFrame, truth: DataFrame) -> DataFrame:
    """Pages inside each missing section's window without confirmed pages, scored; ``top`` marks the pick.

    The pick has the exact number, else any number, else the best score. ``windows``: set_id, bag, previous_page, next_page.
    """
    open_pages = pages.join(truth.select(SET, "page"), [SET, "page"], "left_anti")
    wide = windows.filter("next_page - previous_page >= 2").withColumn("from_page", F.col("previous_page") + 1)
    # windows lie between neighbouring starts: a page is in one of them at most, which several missing sections may share
    gaps = wide.groupBy(SET, "from_page").agg(F.max("next_page").alias("to_page"))
    inside = runs_asof(open_pages, gaps, SET, "page", "from_page", ["from_page", "to_page"]).filter("page < to_page").drop("to_page").join(wide, [SET, "from_page"])
    rows = inside.withColumn("start", F.col("previous_page") + 1).withColumn("end", F.col("next_page") - 1)
    score, reasons = window_score()
    rows = rows.withColumn("score", score).withColumn("reasons", F.size(reasons))
    prefer = F.when(F.col("detected") == F.col("bag"), 0).when(F.col("detected").isNotNull(), 1).otherwise(2)
    w = Window.partitionBy(SET, "bag").orderBy(prefer, F.desc("score"), "page")
    return rows.withColumn("top", F.row_number().over(w) == 1).select(SET, "bag", "page", "score", "reasons", "top")


def page_in_range(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """The section whose range holds each page: an as-of step over starts, since sections don't overlap."""
    marks = starts.select(SET, "page", "bag", F.lit(0).alias("asks"))
    both = marks.unionByName(pages.select(SET, "page", F.lit(None).cast("int").alias("bag"), F.lit(1).alias("asks")))
    w = Window.partitionBy(SET).orderBy("page", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bag", F.last("bag", ignorenulls=True).over(w)).filter("asks = 1 AND bag IS NOT NULL").select(SET, "page", "bag")


def page_range_expand(ranges: DataFrame) -> DataFrame:
    """P10: ``78,80-82`` to distinct pages; reversed ranges count too."""
    part = ranges.select("key", F.explode(F.split("text", ",")).alias("p")).withColumn("lo", F.regexp_extract("p", r"^\s*(\d+)", 1).try_cast("int")).withColumn("hi", F.coalesce(F.regexp_extract("p", r"-\s*(\d+)\s*$", 1).try_cast("int"), F.col("lo")))
    return part.filter("lo IS NOT NULL").select("key", F.explode(F.sequence(F.least("lo", "hi"), F.greatest("lo", "hi"))).alias("page")).distinct()


def front_matter(clusters: DataFrame, last: int = 5) -> DataFrame:
    """Clusters that start in the front matter are evidence only."""
    return clusters.withColumn("evidence_only", F.col("start_page") <= last)


def verify_prefilter(roles: DataFrame) -> DataFrame:
    """First reason why a page isn't sent for verification, or null. Reads the page's own main steps, as intended."""
    why = F.when(F.col("page") <= 3, "front page").when(F.col("previous_max").isNull(), "no previous steps").when(F.col("previous_max") < 10, "previous max below 10").when(F.coalesce(F.col("step_min") != 1, F.lit(True)), "no step 1").when(F.col("drop") < 10, "drop below 10")
    return roles.withColumn("skip_reason", why)


def transition_role(roles: DataFrame, evidence: Column) -> DataFrame:
    """A hero candidate with strong evidence becomes a hero transition reset."""
    return roles.withColumn("role", F.when(F.col("hero") & (F.col("role") != "step_sequence_reset") & evidence, "hero_transition_reset").otherwise(F.col("role")))


def clean_gate(state: Column, status: Column) -> Column:
    """Reason a candidate is held back, or ``pass``."""
    return F.when(F.coalesce(state, F.lit("")).isin("rejected", "blocked"), "not_clean").when(F.coalesce(status != "accepted", F.lit(True)), "not_accepted").otherwise("pass")


def accept_gate(qty_detected: Column, state: Column, scrubbed: Column) -> Column:
    """Accepting needs no detected quantity, a clean state or a scrubbed path."""
    return ~F.coalesce(qty_detected, F.lit(False)) | F.coalesce(state == "clean", F.lit(False)) | F.coalesce(scrubbed != "", F.lit(False))


def asset_filter(path: Column) -> Column:
    """Image suffixes only, without debug names or cache folders."""
    return F.rlike(path, F.lit(r"(?i)\.(png|jpe?g|webp)$")) & ~F.rlike(path, F.lit(r"(?i)(debug|overlay|contact)[^/]*$")) & ~F.rlike(path, F.lit(r"(^|/)(cache|tmp)/"))


def asset_plan(slots: DataFrame) -> DataFrame:
    """Three roles of each slot as rows with target keys; the first occurrence of a path stays, other files are left out."""
    long = slots.unpivot(["slot"], ["page_path", "crop_path", "cutout_path"], "role", "path").filter("path IS NOT NULL AND path <> ''").filter(asset_filter(F.col("path")))
    first = Window.partitionBy("path").orderBy("slot", "role")
    return long.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("slot", "role", "path", F.concat_ws("/", F.lit("assets"), "role", F.regexp_extract("path", "[^/]+$", 0)).alias("target"))


def asset_skips(slots: DataFrame) -> DataFrame:
    """For each role how many paths are there, how many aren't images to send, and how many repeat one sent already."""
    long = slots.unpivot(["slot"], ["page_path", "crop_path", "cutout_path"], "role", "path").filter("path IS NOT NULL AND path <> ''")
    sent = asset_plan(slots).groupBy("role").agg(F.count("*").alias("sent"))
    found = long.groupBy("role").agg(F.count("*").alias("paths"), F.count_if(~asset_filter(F.col("path"))).alias("skipped"))
    return found.join(sent, "role", "left").na.fill(0, ["sent"]).withColumn("repeated", F.col("paths") - F.col("skipped") - F.col("sent"))


def parity(sections: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Each expected step against old and new evidence, classified in order."""
    rows = sections.join(old.select(SET, "value", F.lit(True).alias("old")).distinct(), [SET, "value"], "full").join(new.select(SET, "value", F.lit(True).alias("new")).distinct(), [SET, "value"], "full").na.fill(False, ["expected", "old", "new"])
    c = F.col
    kind = F.when(c("expected") & c("old") & c("new"), "PARITY_MATCH").when(c("expected") & c("old"), "V2_FAILURE").when(~c("expected") & c("new"), "FALSE_STEP").when(c("expected") & ~c("old") & ~c("new"), "EMPTY_STEP").otherwise("V1_TRUTH_INCOMPLETE")
    return rows.withColumn("class", kind)


def class_counts(rows: DataFrame, column: str = "class") -> DataFrame:
    """Rows of each class."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def parity_gate(rows: DataFrame) -> DataFrame:
    """Q07: a section passes if every step matches and nothing is false, missing or incomplete."""
    return rows.groupBy(SET).agg(F.count_if(F.col("class") == "V2_FAILURE").alias("missing"), F.count_if(F.col("class") == "FALSE_STEP").alias("false_steps"), F.bool_and(F.col("class") == "PARITY_MATCH").alias("passes"))


def required_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Q01: (keys, field) of each missing field; a blank text is missing."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields)))
    return rows.select(*keys, F.explode(missing).alias("field"))


def nonzero_count(declared: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Q02: stages whose declared count isn't positive or that list nothing."""
    n = entries.groupBy(key).agg(F.count("*").alias("listed"))
    return declared.join(n, key, "left").na.fill(0, ["listed"]).filter("coalesce(declared, 0) <= 0 OR listed = 0")


def path_referential(references: DataFrame, files: DataFrame) -> DataFrame:
    """Q03: references whose file isn't listed or climbs out of the root."""
    return references.filter(F.rlike("path", F.lit(r"(^/|(^|/)\.\.(/|$))"))).unionByName(references.filter(~F.rlike("path", F.lit(r"(^/|(^|/)\.\.(/|$))"))).join(files, "path", "left_anti"))


def stage_order(stages: DataFrame, key: str) -> DataFrame:
    """Q04: stages of a run that are missing between 0 and its last."""
    tops = stages.groupBy(key).agg(F.max("stage").alias("top"))
    return tops.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("stage")).join(stages.select(key, F.col("stage").cast("long").alias("stage")), [key, "stage"], "left_anti")


def path_parity(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Q05: for each key whether either side has a path and whether they are the same."""
    rows = old.select(key, F.col("path").alias("old_path")).join(new.select(key, F.col("path").alias("new_path")), key, "full")
    return rows.withColumn("same", F.col("old_path").eqNullSafe(F.col("new_path")))


def id_presence(rows: DataFrame, column: str) -> DataFrame:
    """Q06: rows, and rows without an id."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(F.col(column)), F.lit("")) == "").alias("without_id"))

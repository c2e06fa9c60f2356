"""Acceptance of section starts, crop ids, misread numbers, and parity of two runs. All of it is DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.functions import scalars as s

SET = "set_id"
# fixed values: roles of a reset, areas a number box needs, digits that probes report by mistake
RESETS = ("step_sequence_reset", "hero_transition_reset")
AREA_EXPECTED, AREA_ALONE = 20_000, 40_000
PROBE_DIGITS = (1, 4, 7)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes struct<x, y, w, h> share some area; null or empty ones share none."""
    sized = (a["w"] > 0) & (a["h"] > 0) & (b["w"] > 0) & (b["h"] > 0)
    apart = (a["x"] + a["w"] <= b["x"]) | (b["x"] + b["w"] <= a["x"]) | (a["y"] + a["h"] <= b["y"]) | (b["y"] + b["h"] <= a["y"])
    return F.coalesce(sized & ~apart, F.lit(False))


def decide_starts(pages: DataFrame) -> DataFrame:
    """Which pages start a section, by which layout, and the first reason against it.

    ``pages``: set_id, page, role and allowed (of the step sequence), detected (number or null), inferred and inferred_source
    (as ``infer_number`` gives them), number_found, number_area, number_box, card, white_box, strict_panel, several_steps,
    expected (next number or null), step_boxes array of the page's main steps. Null flags count as false.
    """
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    reset = F.coalesce(c("role").isin(*RESETS), F.lit(False))
    white = F.when(yes("white_box"), c("inferred"))
    by_reset = F.when(c("detected").isNull() & white.isNull() & reset & yes("strict_panel"), c("inferred"))
    rows = pages.withColumns({"_white": white, "_reset": by_reset, "_bag": F.coalesce(white, "detected", by_reset)})
    rows = rows.withColumns({
        "by_white": c("_white").isNotNull(),
        "by_card": yes("card"),
        "by_reset": reset & c("_bag").isNotNull() & (yes("number_found") | c("_reset").isNotNull()),
        "by_strict": yes("strict_panel") & yes("number_found"),
    })
    transition = c("by_white") | c("by_reset")
    layout = F.when(c("by_white"), "white_box_transition").when(c("by_card"), "card").when(c("by_reset") & (c("role") == RESETS[1]), RESETS[1]).when(c("by_reset"), "transition_reset").when(c("by_strict"), "strict_top_left")
    small = c("number_area") <= F.when(c("expected").isNotNull(), AREA_EXPECTED).otherwise(AREA_ALONE)
    against = [
        ("no_bag_number", c("_bag").isNull()),
        ("multi_step_green_boxes", yes("several_steps")),
        ("build_step_sequence_page", (F.coalesce(c("role") == "build_step_sequence_page", F.lit(False)) | ~F.coalesce("allowed", F.lit(True))) & ~c("by_white")),
        ("no_number_box", ~yes("number_found") & ~transition),
        ("number_box_area_too_small", F.coalesce(small, F.lit(False)) & ~c("by_card") & ~transition),
        ("step_box_contaminates_bag_number", F.coalesce(F.exists("step_boxes", lambda b: overlaps(b, c("number_box"))), F.lit(False))),
        ("no_valid_bag_start_pattern", layout.isNull()),
    ]
    reason = F.lit(None).cast("string")
    for name, when in reversed(against):
        reason = F.when(when, name).otherwise(reason)
    rows = rows.withColumns({"layout": layout, "reason": reason, "source": F.when(c("by_white") | c("_reset").isNotNull(), c("inferred_source"))})
    return rows.select(SET, "page", c("_bag").alias("bag"), "layout", "source", F.when(c("reason").isNull(), "accepted").otherwise("rejected").alias("decision"), "reason")


def resolve_crop_ids(entries: DataFrame, labels: DataFrame, tolerance: int = 8) -> DataFrame:
    """The id of each call-out (entry, crop_id, page, step, box, crop_index).

    Its own, else that of the only label (crop_id, page, step, box, nth) of its page and step, else of the first label by
    ``nth`` whose box is within ``tolerance`` in every side, else ``pP_sS_cI`` with index 1 where there is none.
    """
    own = F.nullif(F.trim("crop_id"), F.lit(""))
    asked = entries.select("entry", own.alias("own"), "page", "step", F.col("box").alias("a"), "crop_index")
    known = labels.select("page", "step", F.col("crop_id").alias("label"), F.col("box").alias("b"), "nth")
    close = F.lit(True)
    for side in ("x", "y", "w", "h"):
        close = close & (F.abs(F.col("a")[side] - F.col("b")[side]) <= tolerance)
    met = asked.filter("own IS NULL").join(known, ["page", "step"]).groupBy("entry").agg(F.count("*").alias("n"), F.min("label").alias("only"), F.min_by("label", F.when(close, F.col("nth"))).alias("near"))
    made = F.concat(F.lit("p"), F.coalesce("page", F.lit(0)), F.lit("_s"), F.coalesce("step", F.lit(0)), F.lit("_c"), F.coalesce("crop_index", F.lit(1)))
    found = F.when(F.col("own").isNotNull(), F.struct(F.col("own").alias("id"), F.lit("own").alias("rule"))).when(F.col("n") == 1, F.struct(F.col("only").alias("id"), F.lit("sole_label").alias("rule"))).when(F.col("near").isNotNull(), F.struct(F.col("near").alias("id"), F.lit("close_label").alias("rule"))).otherwise(F.struct(made.alias("id"), F.lit("made").alias("rule")))
    return asked.join(met, "entry", "left").withColumn("f", found).select("entry", F.col("f.id").alias("crop_id"), "f.rule")


def classify_misreads(detections: DataFrame, valid: DataFrame, skipped: DataFrame) -> DataFrame:
    """Numbers of a page that are misreadings of one of its valid steps, with that step and the rule.

    ``detections``: set_id, page, value, source, parent, components, is_primary; ``valid``: set_id, page, step;
    ``skipped``: (set_id, page, value) that are noise or sub-steps. Each number's best rule wins, then the nearest step,
    the lower step, and the order of the rules. One row for each page, number and corrected step.
    """
    steps = valid.groupBy(SET, "page").agg(F.array_sort(F.collect_set("step")).alias("steps"))
    rows = detections.join(skipped.select(SET, "page", "value").distinct(), [SET, "page", "value"], "left_anti").join(steps, [SET, "page"]).filter(~F.array_contains("steps", F.col("value")))
    c, text = F.col, F.col("value").cast("string")
    prefix = lambda v: v.cast("string").startswith(text)
    swapped = lambda v: (F.abs(v - c("value")) <= 100) & (F.array_contains(s.ocr_variants(v), c("value")) | F.array_contains(s.ocr_variants(c("value")), v))
    probe = c("value").isin(*PROBE_DIGITS) & ((F.coalesce("components", F.lit(0)) <= 1) | F.coalesce(c("source").isin("step_probe", "full_page_audit"), F.lit(False))) & ~F.coalesce("is_primary", F.lit(False)) & F.forall("steps", lambda v: v >= 20)
    one, some = F.size("steps") == 1, F.exists("steps", prefix)
    least = F.array_min("steps")
    # fixed values: the rules with their scores, in order
    rules = [
        ("rejected_read_of_valid_anchor", 0.99, lambda v: F.coalesce(c("source").endswith("rejected_read"), F.lit(False)) & F.coalesce(c("parent") == v, F.lit(False))),
        ("prefix_fragment_of_valid_step", 0.95, lambda v: prefix(v) & (F.length(text) < F.length(v.cast("string")))),
        ("digit_swap_variant_of_valid_step", 0.92, swapped),
        ("spurious_probe_digit_single_valid_step", 0.88, lambda v: probe & one),
        ("prefix_fragment_of_valid_step", 0.90, lambda v: probe & ~one & some & prefix(v)),
        ("spurious_probe_digit_on_multi_step_page", 0.85, lambda v: probe & ~one & ~some & (v == least)),
    ]
    offer = lambda v, k, name, score, when: F.when(when(v), F.struct((-F.lit(score)).alias("score"), F.abs(v - c("value")).alias("apart"), v.alias("step"), F.lit(k).alias("nth"), F.lit(name).alias("rule")))
    offers = F.flatten(F.transform("steps", lambda v: F.array(*(offer(v, k, *rule) for k, rule in enumerate(rules)))))
    best = rows.withColumn("best", F.array_min(F.filter(offers, lambda o: o.isNotNull()))).filter("best IS NOT NULL")
    return best.groupBy(SET, "page", "value", F.col("best.step").alias("corrected")).agg(F.min(F.struct("best.score", "best.nth", "best.rule")).alias("b")).select(SET, "page", "value", "corrected", "b.rule", (-F.col("b.score")).alias("score"))


def gap_parity(gaps: DataFrame, labels: DataFrame, cache: DataFrame, old: DataFrame, new: DataFrame, callouts: DataFrame, same_page: tuple[int, ...] = ()) -> DataFrame:
    """Each step that a sequence lacks against five evidence tables, all keyed by (set_id, value), classified in order.

    ``gaps``: set_id, value, gap_page, anchor. ``labels`` and ``cache``: presence. ``old``: detections of the old run.
    ``new``: page, audit_only. ``callouts``: presence in either run. Steps of ``same_page`` need their detection on the gap's page.
    """
    key = [SET, "value"]
    flag = lambda df, name: df.select(*key, F.lit(True).alias(name)).distinct()
    seen = new.groupBy(*key).agg(F.min("page").alias("new_page"), F.bool_or("audit_only").alias("audit_only"), F.lit(True).alias("new"))
    rows = gaps.join(flag(labels, "label"), key, "left").join(flag(cache, "cached"), key, "left").join(flag(old, "old"), key, "left").join(seen, key, "left").join(flag(callouts, "callout"), key, "left")
    rows = rows.na.fill(False, ["anchor", "label", "cached", "old", "new", "audit_only", "callout"])
    c = F.col
    visible = c("old") | c("new") | c("anchor")
    moved = c("value").isin(*same_page) & ~c("gap_page").eqNullSafe(c("new_page")) if same_page else F.lit(False)
    kind = (
        F.when(c("label") & c("cached"), "PARITY_MATCH")
        .when(c("label") | (c("new") & c("callout") & ~c("cached")), "V2_FAILURE")
        .when(~visible, "FALSE_STEP")
        .when(moved | (c("new") & ~c("old") & c("audit_only")), "V2_FAILURE")
        .when(~c("callout"), "EMPTY_STEP")
        .otherwise("V1_TRUTH_INCOMPLETE")
    )
    lacks = F.array_compact(F.array(*(F.when(~c(name), F.lit(name)) for name in ("label", "cached", "old", "new", "callout", "anchor"))))
    return rows.select(*key, kind.alias("class"), F.array_join(lacks, ",").alias("lacks"))


def section_parity(sections: DataFrame, found: DataFrame, ids: tuple[DataFrame, DataFrame], steps: tuple[DataFrame, DataFrame], labels: DataFrame, visible: DataFrame, quantities: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Q07: seven invariants of each section (set_id, bag), and whether all hold.

    ``sections`` and ``found``: start_page, end_page; ``ids``: old and new crop_id; ``steps``: expected and new value; ``labels``:
    crop_id of reviewed records; ``visible``: value of steps with a visible call-out, which need a new crop_id row of
    that value in ``ids[1]``; ``quantities``: old and new (crop_id, qty), where the old one is known.
    """
    parts = zip(ROLES, (ids[0], ids[1], steps[0], steps[1], labels, visible, quantities[0], quantities[1]))
    facts = None
    for role, rows in parts:
        more = role_facts(rows, {role: F.lit(True)})
        facts = more if facts is None else facts.unionByName(more)
    return section_parity_of(sections, found, facts)


# what a row of facts says: each may play several of these roles
ROLES = ("old_id", "new_id", "expected", "present", "label", "visible", "old_qty", "new_qty")
_FACTS = {"crop_id": "string", "value": "long", "old_qty": "double", "new_qty": "double"}


def role_facts(rows: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """Facts of Q07 from rows (set_id, bag and what their roles need of crop_id, value and qty) with the conditions of their roles.

    A qty counts as the old or the new one by its role; rows that play both bring old_qty and new_qty instead.
    """
    c, names = F.col, set(rows.columns)
    bits = sum((F.when(F.coalesce(when, F.lit(False)), 1 << ROLES.index(role)).otherwise(0) for role, when in roles.items()), F.lit(0))
    source = {n: n if n in names else "qty" if n in roles and "qty" in names else None for n in _FACTS}
    return rows.select(SET, "bag", *((c(source[n]) if source[n] else F.lit(None)).cast(kind).alias(n) for n, kind in _FACTS.items()), bits.cast("int").alias("roles")).filter("roles > 0")


def section_parity_of(sections: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """Q07 of facts as ``role_facts`` gives them: one shuffle by section, then counts within it.

    A fact counts in up to four ways: by crop id, by step of the sequence, by step with a crop, and by crop id and quantity.
    """
    key, c = [SET, "bag"], F.col
    plays = lambda *roles: c("roles").bitwiseAND(sum(1 << ROLES.index(r) for r in roles)) > 0
    one = lambda role: (plays(role) if role else F.lit(False)).cast("long")
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    entry = lambda kind, crop, value, qty, *roles: F.struct(F.lit(kind).alias("kind"), crop.alias("crop"), value.alias("value"), qty.alias("qty"), *(one(r).alias(n) for r, n in zip(roles, "pqr")))
    no_value = F.lit(None).cast("long")
    ways = [
        F.when(plays("old_id", "new_id", "label"), entry("id", c("crop_id"), no_value, nothing, "old_id", "label", "new_id")),
        F.when(plays("expected", "present"), entry("step", none, c("value"), nothing, "expected", "present", None)),
        F.when(plays("visible", "new_id"), entry("crop", none, c("value"), nothing, "visible", None, "new_id")),
        F.when(plays("old_qty") & c("old_qty").isNotNull(), entry("qty", c("crop_id"), no_value, c("old_qty"), "old_qty", None, None)),
        F.when(plays("new_qty"), entry("qty", c("crop_id"), no_value, c("new_qty"), None, None, "new_qty")),
    ]
    rows = facts.repartition(*key).select(*key, F.explode(F.array_compact(F.array(*ways))).alias("e")).select(*key, "e.*")
    sums = [F.sum(n).alias(n) for n in "pqr"]
    by_qty = rows.groupBy(*key, "kind", "crop", "value", "qty").agg(*sums)
    by_name = by_qty.groupBy(*key, "kind", "crop", "value").agg(*sums, F.sum(F.when(c("qty").isNotNull(), c("p") * c("r")).otherwise(0)).alias("equal"))
    named = F.coalesce("crop", c("value").cast("string")).isNotNull()  # what has no name equals nothing
    lacking = lambda kind, of, other: F.sum(F.when((c("kind") == kind) & ~(named & (c(other) > 0)), c(of)).otherwise(0))
    counts = {
        "missing_ids": lacking("id", "p", "r"),
        "missing_steps": lacking("step", "p", "q"),
        "false_steps": lacking("step", "q", "p"),
        "unresolved": lacking("id", "q", "r"),
        "missing_crops": lacking("crop", "p", "r"),
        "qty_mismatch": F.sum(F.when((c("kind") == "qty") & named, c("p") * c("r") - c("equal")).otherwise(0)),
    }
    counted = by_name.groupBy(*key).agg(*(n.alias(name) for name, n in counts.items()))
    range_holds = c("start_page").eqNullSafe(c("s")) & c("end_page").eqNullSafe(c("e"))
    out = sections.join(found.select(*key, c("start_page").alias("s"), c("end_page").alias("e")), key, "left").join(counted, key, "left").na.fill(0, list(counts)).withColumn("range_holds", range_holds)
    holds = c("range_holds")
    for name in counts:
        holds = holds & (c(name) == 0)
    return out.select(*key, "range_holds", *counts, (c("missing_steps") + c("false_steps") == 0).alias("exact_steps"), holds.alias("passes"))


def runs_asof(points: DataFrame, runs: DataFrame, key: str, at: str, low: str, carried: list[str]) -> DataFrame:
    """``points`` (key, at) with ``carried`` of the last run that begins at or before them: one pass over a union, no range join.

    Runs of a key are disjoint, so whether a point lies inside is for the caller to see from the run's end among ``carried``.
    """
    marks = runs.select(key, F.col(low).alias(at), F.struct(*carried).alias("_run"), F.lit(0).alias("_asks"))
    other = [c for c in points.columns if c not in (key, at)]
    rows = points.select(key, at, F.lit(None).cast(marks.schema["_run"].dataType).alias("_run"), F.lit(1).alias("_asks"), F.struct(F.lit(1).alias("_one"), *other).alias("_rest"))
    both = marks.withColumn("_rest", F.lit(None).cast(rows.schema["_rest"].dataType)).unionByName(rows)
    w = Window.partitionBy(key).orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_held", F.last("_run", ignorenulls=True).over(w)).filter("_asks = 1 AND _held IS NOT NULL")
    return held.select(key, at, *(F.col(f"_rest.{c}").alias(c) for c in other), "_held.*")

"""Window and sequence operators over pages, printed steps and section starts of many manuals at once.

Every operator partitions by ``set_id``; one shuffle by it serves a chain of them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.operators.acceptance import runs_asof
from stepweave.operators.grouped import fold_groups

SET = "set_id"


def _before(order: str = "page") -> Window:
    return Window.partitionBy(SET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def page_step_set(steps: DataFrame) -> DataFrame:
    """Distinct positive steps of each page, sorted."""
    return steps.filter("value > 0").groupBy(SET, "page").agg(F.sort_array(F.collect_set("value")).alias("steps"))


def page_range(steps: DataFrame) -> DataFrame:
    """Smallest and largest positive step of each page, pages without one kept with nulls."""
    v = F.when(F.col("value") > 0, F.col("value"))
    return steps.groupBy(SET, "page").agg(F.min(v).alias("step_min"), F.max(v).alias("step_max"))


def step_roles(steps: DataFrame) -> DataFrame:
    """Role of each page against the largest step of the last page that had steps."""
    rows = page_range(steps).withColumn("previous_max", F.last("step_max", ignorenulls=True).over(_before()))
    drop = F.col("previous_max") - F.col("step_min")
    strong = (F.col("previous_max") >= 20) & (drop >= 10)
    role = (
        F.when(F.col("step_min").isNull(), "no_step_data")
        .when(strong & (F.col("step_min") <= 3), "step_sequence_reset")
        .when((F.col("step_min") >= F.col("previous_max")) & (F.col("step_max") >= F.col("previous_max")), "build_step_sequence_page")
        .otherwise("ambiguous")
    )
    hero = F.coalesce(strong & (F.col("step_min") <= 9), F.lit(False))
    return rows.withColumn("drop", drop).withColumn("role", role).withColumn("hero", hero).withColumn("start_allowed", F.col("role") != "build_step_sequence_page")


def reset_score(previous: Column, low: Column, high: Column, steps: Column) -> Column:
    """Confidence 0..1 that a drop from ``previous`` to ``low`` starts a section."""
    drop = previous - low
    parts = (
        F.when(low <= 2, 0.35).otherwise(0.0) + F.when(low == 1, 0.15).otherwise(0.0) + F.when(previous >= 8, 0.20).when(previous >= 6, 0.10).otherwise(0.0)
        + F.when(drop >= 10, 0.25).when(drop >= 6, 0.18).when(drop >= 4, 0.08).otherwise(0.0)
        + F.when((F.size(steps) >= 2) & (high <= 4), 0.10).otherwise(0.0) + F.when(F.array_contains(steps, 1) & F.array_contains(steps, 2), 0.10).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.bround(parts, 3))


def reset_scan(steps: DataFrame, limit: int = 200, least: int = 10) -> DataFrame:
    """Pages that restart at 1 after a drop of ``least`` or more; pages with a step over ``limit`` are passed over.

    One row for each page with its reason; a passed-over page doesn't become the page to compare with.
    """
    pages = steps.filter("value > 0").groupBy(SET, "page").agg(F.sort_array(F.collect_set("value")).alias("steps"), F.min("value").alias("low"), F.max("value").alias("high"))
    rows = pages.withColumn("valid", F.col("high") <= limit).withColumn("previous", F.last(F.when(F.col("valid"), F.col("high")), ignorenulls=True).over(_before()))
    to = F.when(F.array_contains("steps", 1), F.lit(1)).otherwise(F.col("low"))
    drop = F.col("previous") - to
    start = F.col("valid") & F.array_contains("steps", 1) & (F.col("previous") >= least) & (drop >= least)
    reason = F.when(~F.col("valid"), "implausible step").when(start, "reset").when(drop > 0, "rejected reset").otherwise("")
    score = F.when(F.col("valid"), reset_score(F.col("previous"), to, F.col("high"), F.col("steps")))
    return rows.select(SET, "page", "low", "high", "previous", F.when(F.col("valid"), drop).alias("drop"), F.coalesce(start, F.lit(False)).alias("bag_start"), reason.alias("reason"), score.alias("confidence"))


def min_spacing(starts: DataFrame, spacing: int = 5, most: int = 30) -> DataFrame:
    """Greedy suppression per manual in page order.

    A candidate within ``spacing`` pages of a kept one replaces it if it ranks higher by (previous, drop, confidence, -page);
    replaced entries aren't compared again. At most ``most`` stay, a limit that is part of the rule.
    """
    rank = lambda r: (r["previous"], r["drop"], r["confidence"], -r["page"])

    def keep(rows: Iterator[dict]) -> Iterator[dict]:
        kept: list[dict] = []  # those that a later page can still meet
        sent = 0
        for r in rows:
            done = sorted((k for k in kept if r["page"] - k["page"] >= spacing), key=lambda k: k["page"])
            kept = [k for k in kept if r["page"] - k["page"] < spacing]
            for k in done[: most - sent]:
                yield k
            sent = min(most, sent + len(done))
            if not kept:
                kept.append(r)
            elif rank(r) > rank(kept[0]):
                kept[0] = r
        yield from sorted(kept, key=lambda k: k["page"])[: most - sent]

    lean = starts.select(SET, "page", "previous", "drop", "confidence")
    return fold_groups(lean, SET, ["page"], keep, lean.schema)


def missing_numbers(truth: DataFrame) -> DataFrame:
    """Numbers from 1 to the largest of each manual that are absent."""
    tops = truth.filter("bag > 0").groupBy(SET).agg(F.max("bag").alias("top"))
    return tops.select(SET, F.explode(F.sequence(F.lit(1), F.col("top"))).alias("bag")).join(truth.select(SET, "bag"), [SET, "bag"], "left_anti")


def missing_windows(truth: DataFrame) -> DataFrame:
    """For each missing number the confirmed ones around it with their first pages; a scan needs both sides and room."""
    firsts = truth.filter("bag > 0").groupBy(SET, "bag").agg(F.min("page").alias("page"))
    both = firsts.withColumn("missing", F.lit(False)).unionByName(missing_numbers(truth).withColumn("page", F.lit(None).cast("int")).withColumn("missing", F.lit(True)))
    after = Window.partitionBy(SET).orderBy("bag").rowsBetween(1, Window.unboundedFollowing)
    known = F.when(~F.col("missing"), F.struct("bag", "page"))
    rows = both.withColumn("prev", F.last(known, ignorenulls=True).over(_before("bag"))).withColumn("next", F.first(known, ignorenulls=True).over(after)).filter("missing")
    rows = rows.select(SET, "bag", F.col("prev.bag").alias("previous_bag"), F.col("prev.page").alias("previous_page"), F.col("next.bag").alias("next_bag"), F.col("next.page").alias("next_page"))
    open_side = F.col("previous_page").isNotNull() | F.col("next_page").isNotNull()
    return rows.withColumn("bounded", open_side).withColumn("scannable", F.coalesce(F.col("next_page") - F.col("previous_page") >= 2, F.lit(False)))


def ranges_from_starts(starts: DataFrame, manual: DataFrame) -> DataFrame:
    """Each section ends before the next starts, the last one with the manual (set_id, last_page)."""
    following = F.lead("page").over(Window.partitionBy(SET).orderBy("page"))
    rows = starts.withColumn("next_page", following).join(manual, SET)
    return rows.select(SET, "bag", F.col("page").alias("start_page"), F.coalesce(F.col("next_page") - 1, F.col("last_page")).alias("end_page"))


def gap_clusters(pages: DataFrame, gap: int = 6) -> DataFrame:
    """Pages sessionised: a new cluster where the distance to the page before exceeds ``gap``."""
    w = Window.partitionBy(SET).orderBy("page")
    rows = pages.select(SET, "page").distinct().withColumn("fresh", F.coalesce((F.col("page") - F.lag("page").over(w) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("cluster", F.sum("fresh").over(w))
    return rows.groupBy(SET, "cluster").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("pages"))


def consecutive_runs(numbers: DataFrame, key: str = SET, value: str = "value") -> DataFrame:
    """Maximal runs of consecutive values."""
    rows = numbers.select(key, value).filter(F.col(value).isNotNull()).distinct()
    rows = rows.withColumn("island", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value)))
    return rows.groupBy(key, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("island")


def visible_runs(numbers: DataFrame, emitted: DataFrame, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more that touch an emitted value; where a set emitted nothing, all of them count."""
    runs = consecutive_runs(numbers).filter(F.col("length") >= least)
    given = emitted.select(SET, "value").distinct()
    inside = runs_asof(given, runs, SET, "value", "first", ["first", "last", "length"]).filter("value <= last")
    hit = inside.select(*runs.columns).distinct()
    given = given.select(F.col(SET).alias("_set"))
    silent = runs.join(given, F.col(SET) == F.col("_set"), "left_anti")
    return hit.union(silent)


def completeness(numbers: DataFrame, emitted: DataFrame, least: int = 3) -> DataFrame:
    """Values of visible runs that weren't emitted."""
    expected = visible_runs(numbers, emitted, least).select(SET, F.explode(F.sequence("first", "last")).alias("value"))
    return expected.join(emitted.select(SET, "value"), [SET, "value"], "left_anti")


def gap_threshold(starts: DataFrame, least: int = 20, times: float = 1.5) -> DataFrame:
    """Deltas between starts that reach max(``least``, ``times`` the manual's median delta, rounded half to even)."""
    rows = starts.withColumn("next_page", F.lead("page").over(Window.partitionBy(SET).orderBy("page"))).filter("next_page is not null").withColumn("delta", F.col("next_page") - F.col("page"))
    limits = rows.groupBy(SET).agg(F.greatest(F.lit(least), F.bround(F.median("delta") * times, 0).cast("int")).alias("threshold"))
    return rows.join(limits, SET).filter("delta >= threshold").select(SET, "page", "next_page", "delta", "threshold")


def sequence_gaps(known: DataFrame) -> DataFrame:
    """Values missing between neighbouring known steps (set_id, value, page), each with an interpolated page."""
    w = Window.partitionBy(SET).orderBy("value", "page")
    rows = known.groupBy(SET, "value").agg(F.min("page").alias("page"))
    rows = rows.select(SET, F.col("value").alias("left_step"), F.col("page").alias("left_page"), F.lead("value").over(w).alias("right_step"), F.lead("page").over(w).alias("right_page")).filter("right_step - left_step > 1")
    rows = rows.withColumn("step", F.explode(F.expr("sequence(left_step + 1, right_step - 1)")))
    apart = F.col("right_page") - F.col("left_page")
    even = F.greatest(F.lit(0), F.bround(apart * (F.col("step") - F.col("left_step")) / (F.col("right_step") - F.col("left_step")), 0).cast("int"))
    page = F.when(apart.isin(0, 1), F.col("left_page")).when(apart == 2, F.col("left_page") + 1).otherwise(F.col("left_page") + even)
    return rows.select(SET, "step", page.alias("page"), "left_step", "right_step")


def _accept(rows: Iterable[dict], expected: int) -> Iterator[dict]:
    for r in rows:
        good = r["bag"] == expected
        yield {**r, "accepted": good, "reason": "" if good else "already passed" if r["bag"] < expected else "not the next number"}
        expected += good


def consecutive_accept(candidates: DataFrame, first: int = 1, pages: int | None = None) -> DataFrame:
    """In page order only the next expected number is kept, which then advances; others say why not. Order-dependent.

    With ``pages`` a manual is cut into ranges of so many pages, each in a task of its own. What a range makes of the number expected at its
    start is a map, the identity but for the numbers that it holds: read backwards, a number leads to what its successor leads to
    from there on. The maps of a manual's ranges are applied one after another, and each range then walks from its own start.
    """
    lean = candidates.select(SET, "page", "bag").filter("bag IS NOT NULL")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema)
    if pages is None:
        return fold_groups(lean, SET, ["page", "bag"], lambda rows: _accept(rows, first), f"{kinds}, accepted boolean, reason string")
    kind = lean.schema[SET].dataType.simpleString()
    dealt = lean.withColumn("span", F.expr(f"cast(page div {int(pages)} AS int)")).withColumn("part", F.struct(SET, "span"))

    def lead(rows: Iterator[dict]) -> list[dict]:
        held = list(rows)
        to: dict[int, int] = {}
        for r in reversed(held):
            to[r["bag"]] = to.get(r["bag"] + 1, r["bag"] + 1)
        return [{SET: held[0][SET], "span": held[0]["span"], "numbers": list(to), "leads": list(to.values())}]

    def starts(rows: Iterator[dict]) -> Iterator[dict]:
        expected = first
        for r in rows:
            yield {SET: r[SET], "span": r["span"], "expected": expected}
            expected = dict(zip(r["numbers"], r["leads"])).get(expected, expected)

    maps = fold_groups(dealt, "part", ["page", "bag"], lead, f"{SET} {kind}, span int, numbers array<int>, leads array<int>")
    begin = fold_groups(maps, SET, ["span"], starts, f"{SET} {kind}, span int, expected int")

    def walk(rows: Iterator[dict]) -> Iterator[dict]:
        head = next(rows)
        return _accept(chain([head], rows), head["expected"])

    return fold_groups(dealt.join(begin, [SET, "span"]).withColumn("part", F.struct(SET, "span")), "part", ["page", "bag"], walk, f"{kinds}, accepted boolean, reason string")


def asof_last_confirmed(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """Number of the last truth row strictly before each page, 0 without one. One pass over the union, no range join."""
    marks = truth.filter("page > 0 and bag > 0").select(SET, "page", "bag", F.lit(1).alias("kind"))
    asked = pages.select(SET, "page", F.lit(None).cast("int").alias("bag"), F.lit(0).alias("kind"))
    w = Window.partitionBy(SET).orderBy("page", "kind", "bag").rowsBetween(Window.unboundedPreceding, -1)  # questions come before marks of their page
    rows = asked.unionByName(marks).withColumn("last_bag", F.coalesce(F.last("bag", ignorenulls=True).over(w), F.lit(0)))
    return rows.filter("kind = 0").select(SET, "page", "last_bag")


def asof_with_provisional(pages: DataFrame, truth: DataFrame, provisional: DataFrame) -> DataFrame:
    """The larger of the last confirmed number and the largest provisional one (set_id, page, bag) strictly before each page."""
    marks = provisional.filter("page > 0 and bag > 0").select(SET, "page", "bag", F.lit(1).alias("kind"))
    asked = asof_last_confirmed(pages, truth).select(SET, "page", F.col("last_bag").alias("bag"), F.lit(0).alias("kind"))
    w = Window.partitionBy(SET).orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, -1)  # questions come before marks of their page
    rows = asked.unionByName(marks).withColumn("most", F.max(F.when(F.col("kind") == 1, F.col("bag"))).over(w))
    return rows.filter("kind = 0").select(SET, "page", F.greatest("bag", F.coalesce("most", F.lit(0))).alias("last_bag"))


def infer_number(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """The truth of the page itself, else the last confirmed number plus 1."""
    own = truth.groupBy(SET, "page").agg(F.min("bag").alias("own"))
    return asof_last_confirmed(pages, truth).join(own, [SET, "page"], "left").select(SET, "page", F.coalesce("own", F.col("last_bag") + 1).alias("bag"), F.when(F.col("own").isNotNull(), "existing_truth_same_page").otherwise("last_confirmed_bag_sequence").alias("source"))


def dominant_step(steps: DataFrame, least: int = 10) -> DataFrame:
    """Largest step of each page among those of ``least`` or more."""
    return steps.filter(F.col("value") >= least).groupBy(SET, "page").agg(F.max("value").alias("dominant"))


def substep_filter(steps: DataFrame, least: int = 10) -> DataFrame:
    """Single-digit values on a page with a dominant step."""
    return steps.filter("value between 1 and 9").join(dominant_step(steps, least), [SET, "page"]).select(SET, "page", "value", "dominant")


def infer_valid_steps(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """For pages without crop steps the previous page's maximum plus the distance, if below the next page's minimum."""
    have = crops.groupBy(SET, "page").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rows = pages.select(SET, "page").distinct().join(have, [SET, "page"], "left")
    after = Window.partitionBy(SET).orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("high").isNotNull(), F.struct("page", "low", "high"))
    rows = rows.withColumn("prev", F.last(known, ignorenulls=True).over(_before())).withColumn("next", F.first(known, ignorenulls=True).over(after)).filter("high is null")
    step = F.col("prev.high") + F.col("page") - F.col("prev.page")
    return rows.withColumn("step", step).filter("step < next.low").select(SET, "page", "step")


def known_sequence(clusters: DataFrame) -> DataFrame:
    """Clusters numbered in page order."""
    return clusters.withColumn("bag", F.row_number().over(Window.partitionBy(SET).orderBy("start_page")))


def sequence_evidence(clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """Numbered clusters with the mean confidence and the pages, in order, of the candidates (set_id, page, confidence) in them."""
    inside = runs_asof(candidates.select(SET, "page", "confidence"), known_sequence(clusters), SET, "page", "start_page", ["bag", "start_page", "end_page"]).filter("page <= end_page")
    return inside.groupBy(SET, "bag", "start_page", "end_page").agg(F.avg("confidence").alias("confidence"), F.array_sort(F.collect_set("page")).alias("evidence"))


def bag_step_range(starts: DataFrame, manual: DataFrame, steps: DataFrame, most_pages: int = 15) -> DataFrame:
    """Each section's range, and the largest step on its first ``most_pages`` pages that have steps."""
    ranges = ranges_from_starts(starts, manual)
    pages = page_range(steps).filter("step_max is not null").select(SET, "page", "step_max")
    near = runs_asof(pages, ranges, SET, "page", "start_page", ["bag", "end_page"]).filter("page <= end_page")
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy(SET, "bag").orderBy("page"))).filter(F.col("nth") <= most_pages)
    return ranges.join(first.groupBy(SET, "bag").agg(F.max("step_max").alias("max_step"), F.count("*").alias("pages_read")), [SET, "bag"], "left").na.fill(0, ["pages_read"])


def context_outliers(steps: DataFrame, span: int = 4, slack: int = 30, ahead: int = 5) -> DataFrame:
    """Values dropped because they lie over ``slack`` above the trimmed maximum of the pages around, without a forward anchor.

    The trimmed maximum leaves out the top fifth of the values on ``span`` pages each way; the forward one, of the pages
    after only, must come within ``ahead`` of the value to keep it. The walk goes forward, and a dropped value is gone from later contexts.
    """

    def trimmed(values: list[int]) -> int:
        values = sorted(values)
        return values[len(values) - int(len(values) * 0.2) - 1] if values else 0

    def walk(rows: Iterator[dict]) -> Iterator[dict]:
        pages = ([page, list(group)] for page, group in groupby(rows, key=lambda r: r["page"]))
        before: deque[list[int]] = deque(maxlen=span)
        waiting = deque(islice(pages, span + 1))
        while waiting:
            page, here = waiting.popleft()
            values = [r["value"] for r in here]
            after = [r["value"] for _, group in waiting for r in group]
            around = [v for group in before for v in group] + after
            if around:
                top, forward = trimmed(around), trimmed(after)
                out = [v for v in values if v > top + slack and forward < v - ahead]
                values = [v for v in values if v not in out]
                yield from ({SET: here[0][SET], "page": page, "value": v} for v in out)
            before.append(values)
            waiting.extend(islice(pages, 1))

    lean = steps.select(SET, "page", "value").filter("value > 0").distinct()
    return fold_groups(lean, SET, ["page", "value"], walk, lean.schema)


def gap_promotion(steps: DataFrame, audit: DataFrame, most: int = 6) -> DataFrame:
    """For a gap of 1..``most`` numbers between a page and the next one, the most confident audit candidate of each missing number.

    Both: set_id, page, value, box; audit also has confidence. A box that the page uses, or that was just promoted, isn't used again.
    """

    def walk(rows: Iterator[dict]) -> Iterator[dict]:
        last: tuple[list[dict], list[dict]] = ([], [])  # steps and offers of the last page with steps
        for page, group in groupby(rows, key=lambda r: r["page"]):
            here = list(group)
            have, offers = [r for r in here if not r["audit"]], [r for r in here if r["audit"]]
            if not have:
                continue
            if last[0]:
                yield from promoted(*last, [r["value"] for r in have], page)
            last = have, offers

    def promoted(have: list[dict], offers: list[dict], following: list[int], next_page: int) -> Iterator[dict]:
        top = max(r["value"] for r in have)
        later = [v for v in following if v > top]
        if not later or not 0 < min(later) - top - 1 <= most:
            return
        used = {r["box"] for r in have}
        for value in range(top + 1, min(later)):
            found = [r for r in offers if r["value"] == value and r["box"] not in used]
            if found:
                best = min(found, key=lambda r: (-r["confidence"], r["box"]))
                used.add(best["box"])
                yield {**{k: best[k] for k in (SET, "page", "value", "box")}, "next_page": next_page}

    columns = [SET, "page", "value", "box"]
    both = steps.select(*columns, F.lit(0.0).alias("confidence"), F.lit(False).alias("audit")).unionByName(audit.select(*columns, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.lit(True).alias("audit"))).filter("value > 0")
    kinds = ", ".join(f"{c} {steps.schema[c].dataType.simpleString()}" for c in columns)
    return fold_groups(both, SET, ["page", "value", "box"], walk, f"{kinds}, next_page {steps.schema['page'].dataType.simpleString()}")

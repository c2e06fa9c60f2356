"""Suspect steps, their repairs, page confidence, and token coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.functions import scalars as s
from stepweave.operators.grouped import fold_groups

SET = "set_id"


def suspect_steps(crops: DataFrame, jump: int = 8, window: int = 12) -> DataFrame:
    """Crops (set_id, page, value) whose step breaks the order of neighbouring pages, with the rules they break.

    Rules: not below the next page's minimum; not above the previous page's maximum; a jump of more than ``jump`` from a
    page at most two before; not the only number that fits between; with a column id_step, an id of another step that breaks
    the order too; with a column detected (array of the page's detected steps, of which those within ``window`` of its
    neighbours and own steps count), a page of one crop where neither its step nor the only one that fits was detected. Crops go
    in (page, step) order, and a page that already has a suspect isn't trusted as the previous page.
    """

    def walk(rows: Iterator[dict]) -> Iterator[dict]:
        before, trusted = None, True  # the page before as (page, maximum), and whether it had no suspect
        pages = (list(group) for _, group in groupby(rows, key=lambda r: r["page"]))
        here = next(pages, None)
        while here:
            following = next(pages, None)
            after = min(r["value"] for r in following) if following else None
            prev = before[1] if before and trusted else None
            found = [{**r, "reasons": why} for r in here if (why := broken(r, here, before, prev, after))]
            yield from ({k: r[k] for k in (SET, "page", "value", "reasons")} for r in found)
            before, trusted, here = (here[0]["page"], max(r["value"] for r in here)), not found, following

    def broken(r: dict, here: list[dict], before: tuple[int, int] | None, prev: int | None, after: int | None) -> list[str]:
        v, own = r["value"], r["id_step"]
        narrow = prev is not None and after is not None and after - prev == 2
        why = []
        if after is not None and v >= after:
            why.append("not below next page")
        if prev is not None and v <= prev:
            why.append("not above previous page")
        if prev is not None and r["page"] - before[0] <= 2 and v - prev > jump:
            why.append("jump")
        if narrow and v != prev + 1:
            why.append("only one number fits")
        if own is not None and own != v and (prev is None or own <= prev or (after is not None and own >= after)):
            why.append("id breaks order too")
        anchors = [x["value"] for x in here] + [x for x in (prev, after) if x is not None]
        seen = [d for d in r["detected"] or [] if min(anchors) - window <= d <= max(anchors) + window]
        if seen and v not in seen and len(here) == 1 and narrow and prev + 1 not in seen:
            why.append("detected steps disagree")
        return why

    extra = {"id_step": "int", "detected": "array<int>"}
    lean = crops.select(SET, "page", "value", *(F.col(c).cast(kind).alias(c) if c in crops.columns else F.lit(None).cast(kind).alias(c) for c, kind in extra.items())).filter("value IS NOT NULL")
    kinds = ", ".join(f"{c} {crops.schema[c].dataType.simpleString()}" for c in (SET, "page", "value"))
    return fold_groups(lean, SET, ["page", "value"], walk, f"{kinds}, reasons array<string>")


def page_neighbours(crops: DataFrame) -> DataFrame:
    """(set_id, page, value, alone, prev_step, next_step): maximum of the page before, minimum of the page after."""
    pages = crops.groupBy(SET, "page").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("crops"))
    w = Window.partitionBy(SET).orderBy("page")
    near = pages.select(SET, "page", (F.col("crops") == 1).alias("alone"), F.lag("high").over(w).alias("prev_step"), F.lead("low").over(w).alias("next_step"))
    return crops.join(near, [SET, "page"])


def propose_step(rows: DataFrame, reach: int = 12) -> DataFrame:
    """Repair of each row (value, id_step, nearest, alone, prev_step, next_step) by the first rule that applies.

    The record's step if only the id disagrees .93; the single number between neighbours .95 (.98 if a digit was confused);
    the middle of a narrow span .82; the nearest detected step .72; a confused digit .68; previous plus 1 .55.
    """
    c = F.col
    after = lambda v: c("prev_step").isNull() | (v > c("prev_step"))
    ahead = lambda v: c("next_step").isNull() | (v < c("next_step"))
    span = c("next_step") - c("prev_step")
    variants = s.ocr_variants(c("value"))
    middle = c("prev_step") + F.greatest(F.lit(1), F.floor(span / 2).cast("int"))
    fitting = F.get(F.filter(variants, lambda v: after(v) & ahead(v)), F.lit(0))
    pick = lambda step, score, rule: F.struct(step.cast("int").alias("step"), F.lit(score).cast("double").alias("confidence") if isinstance(score, float) else score.alias("confidence"), F.lit(rule).alias("rule"))
    gap = c("prev_step") + 1
    confused = F.when(F.array_contains(variants, gap) | (gap == c("value")), 0.98).otherwise(0.95)
    best = (
        F.when(c("id_step").isNotNull() & (c("id_step") != c("value")) & after(c("value")) & ahead(c("value")), pick(c("value"), 0.93, "record_step_fits_sequence"))
        .when(span == 2, pick(gap, confused, "sequence_gap_fill"))
        .when(c("alone") & (span > 0) & (span <= reach) & (middle < c("next_step")), pick(middle, 0.82, "interpolate_between_neighbour_pages"))
        .when((c("nearest") > 0) & after(c("nearest")) & ahead(c("nearest")), pick(c("nearest"), 0.72, "nearest_detected_step_box"))
        .when(fitting.isNotNull(), pick(fitting, 0.68, "ocr_variant_in_sequence_window"))
        .when(c("prev_step").isNotNull() & ahead(gap), pick(gap, 0.55, "fallback_prev_plus_one"))
        .otherwise(pick(F.lit(None), 0.0, "unresolved"))
    )
    return rows.withColumn("p", best).select(SET, "page", "value", "p.*")


def page_confidence(panel: Column, shell: Column, grey: Column, number: Column, bag: Column, shell_score: Column, grey_score: Column) -> Column:
    """weighted confidence of structure and reading, 1 at most."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    score = F.when(panel, 0.15).otherwise(0.0) + F.when(shell, 0.20 + F.when(shell_score.isNotNull(), F.least(shell_score, F.lit(1.0)) * 0.15).otherwise(0.0)).otherwise(0.0)
    score = score + F.when(grey, 0.25 + F.when(grey_score.isNotNull(), unit((grey_score + 40) / 80) * 0.15).otherwise(0.0)).otherwise(0.0) + F.when(number, 0.10).otherwise(0.0) + F.when(bag.isNotNull(), 0.40).otherwise(-0.30)
    return F.bround(F.least(score, F.lit(1.0)) + 1e-9, 3)


def token_rebase(tokens: DataFrame) -> DataFrame:
    """tokens (id, x, y, w, h) in crop coordinates; crop size cw, ch and origin cx, cy on the page.

    The first reading with a non-empty clipped box wins: crop-local, 0..1 of the crop, page minus origin. Others are dropped.
    """
    c = F.col

    def clip(x: Column, y: Column, w: Column, h: Column) -> Column:
        edge = lambda v, top: F.greatest(F.lit(0), F.least(c(top), F.bround(v, 0).cast("int")))
        x1, y1, x2, y2 = edge(x, "cw"), edge(y, "ch"), edge(x + F.greatest(w, F.lit(0)), "cw"), edge(y + F.greatest(h, F.lit(0)), "ch")
        return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2 - x1, y2 - y1))

    x, y, w, h = (c(k).cast("double") for k in ("x", "y", "w", "h"))
    local = clip(x, y, w, h)
    scaled = F.when(x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1), clip(x * c("cw"), y * c("ch"), w * c("cw"), h * c("ch")))
    page = F.when((x >= c("cx")) & (y >= c("cy")), clip(x - c("cx"), y - c("cy"), w, h))
    source = F.when(local.isNotNull(), "crop_local_xywh").when(scaled.isNotNull(), "crop_local_normalized_xywh").when(page.isNotNull(), "page_xywh_minus_crop_origin")
    return tokens.select("id", F.coalesce(local, scaled, page).alias("box"), source.alias("source")).filter("box IS NOT NULL")


def _pictured(rows: DataFrame) -> DataFrame:
    """(set_num, id, grey, r, g, b): the grey values where all of them are there, else null."""
    usable = F.coalesce((F.size("grey") > 0) & ~F.exists("grey", lambda v: v.isNull()), F.lit(False))
    colour = (F.get("rgb", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rgb"))
    return rows.filter("set_num IS NOT NULL").select("set_num", "id", F.when(usable, F.col("grey").cast("array<double>")).alias("grey"), *colour)


def _numbers(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are there."""
    return col.fill_null(0).to_numpy(), col.is_valid().to_numpy()


def _lengths(col: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy()


def _values(col: pa.ChunkedArray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows with ``n`` each, and their hashes as ``scalars.avg_hash`` has them: means added up value by value, NaN above all."""
    x = col.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    mean, bits = np.zeros(len(x)), np.zeros(len(x), np.uint64)
    for d in range(n):
        mean += x[:, d]
    mean /= n
    for d in range(n):
        bits |= ((x[:, d] >= mean) | np.isnan(x[:, d])).astype(np.uint64) << np.uint64(d % 64)
    return x, bits


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each row of ``a`` and each column of ``b``, added up value by value, in tiles that a cache holds."""
    out = np.zeros((len(a), b.shape[1]))
    for lo in range(0, b.shape[1], 2_048):
        tile, apart = out[:, lo : lo + 2_048], np.empty((len(a), min(2_048, b.shape[1] - lo)))
        for d in range(a.shape[1]):
            np.subtract(a[:, d, None], b[d, lo : lo + 2_048], out=apart)
            apart *= apart
            tile += apart
    return out


def _best_of_block(asks: pa.Table, block: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asks``, row of ``block``, score) of the ``k`` best pairs of each ask; ties go to the earlier row of ``block``."""
    an, bn = _lengths(asks["grey"]), _lengths(block["grey"])
    ac, bc = [_numbers(asks[c]) for c in "rgb"], [_numbers(block[c]) for c in "rgb"]
    a_known, b_known = (np.logical_and.reduce([known for _, known in side]) for side in (ac, bc))
    greys = {}  # by length: rows of the block, their values, a column each, and hashes
    for n in np.unique(bn[bn > 0]).tolist():
        at = np.flatnonzero(bn == n)
        values, bits = _values(block["grey"], at, n)
        greys[n] = at, np.ascontiguousarray(values.T), bits
    found = []
    for n in np.unique(an).tolist():
        same = np.flatnonzero(an == n)
        for lo in range(0, len(same), 16):
            part = same[lo : lo + 16]
            apart = sum(((a[part, None] - b[None, :]) ** 2 for (a, _), (b, _) in zip(ac, bc)), np.zeros(1))
            score = np.where(a_known[part, None] & b_known[None, :], np.maximum(0.0, np.fmin(1.0, 1 - np.sqrt(apart) / 441.6729)), 1.0)  # as least and greatest pass over null
            if n in greys:
                (at, values, bits), (asked, own) = greys[n], _values(asks["grey"], part, n)
                mse = _squares(asked, values) / n / (255.0 * 255.0)
                alike = 1 - np.bitwise_count(own[:, None] ^ bits[None, :]) / 64.0
                score[:, at] = 0.55 * (0.62 * alike + 0.38 * (1 - mse)) + 0.45 * score[:, at]
            key = np.where(np.isnan(score), np.inf, score)
            floor = np.partition(key, -k, axis=1)[:, -k] if key.shape[1] > k else np.full(len(part), -np.inf)
            i, j = np.nonzero(key >= floor[:, None])
            by = np.lexsort((j, -key[i, j], i))
            i, j = i[by], j[by]
            good = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((part[i[good]], j[good], score[i[good], j[good]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def library_match(crops: DataFrame, library: DataFrame, k: int = 5, crop_rows: int = 512, item_rows: int = 4_096) -> DataFrame:
    """the ``k`` best library items of each crop's set by .55 image (hash and difference) and .45 colour.

    Both: set_num, id, grey (array of 64 values 0..255 or null), rgb (array). All pairs of a set are compared, in tasks of about
    ``crop_rows`` crops and ``item_rows`` items each, which hash an image once and keep the ``k`` best items of each crop.
    """
    asked, held = _pictured(crops), _pictured(library)
    size = lambda most: F.ceil(F.count("*") / most).cast("int")
    plan = asked.groupBy("set_num").agg(size(crop_rows).alias("turns")).join(held.groupBy("set_num").agg(size(item_rows).alias("parts")), "set_num")
    deal = lambda rows, own, most, other, all_: rows.join(plan, "set_num").withColumn(own, F.expr(f"cast(pmod(xxhash64(id), {most}) AS int)")).withColumn(other, F.explode(F.expr(f"sequence(0, {all_} - 1)"))).drop("parts", "turns")
    keys, names = ["set_num", "part", "turn"], ["set_num", "crop", "item", "score"]
    left, right = deal(asked, "turn", "turns", "part", "parts"), deal(held, "part", "parts", "turn", "turns")
    kinds = {c: d.schema[n].dataType.simpleString() for c, d, n in (("set_num", crops, "set_num"), ("crop", crops, "id"), ("item", library, "id"))}

    def meet(asks: pa.Table, block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block, [("id", "ascending")], null_placement="at_start"))
        i, j, score = _best_of_block(asks, block, k) if asks.num_rows and block.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([asks["set_num"].take(pa.array(i)), asks["id"].take(pa.array(i)), block["id"].take(pa.array(j)), pa.array(score)], names)

    rows = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double")
    w = Window.partitionBy("set_num", "crop").orderBy(F.desc("score"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("set_num", "crop", "rank", "item", "score")


def cluster_gate(detections: DataFrame, width: int = 30, low: int = 25, high: int = 60, components: int = 2, dominant: int = 10) -> DataFrame:
    """Decision for the best detection of each (set_id, page, value): columns components, w, h, score, plausible, substep, misread.

    Size and components pass, are rejected or uncertain; ``plausible`` is true, false or null (unknown). Misreads and
    sub-steps are suppressed first, then what is implausible or rejected; sure ones are accepted, the rest goes to a person.
    """
    rows = detections.groupBy(SET, "page", "value").agg(F.max_by(F.struct("components", "w", "h", "plausible", "substep", "misread"), F.struct("score", "components", "w", "h")).alias("b")).select(SET, "page", "value", "b.*")
    c = F.col
    bad = (c("components") == 1) | (c("w") < width) | (c("h") < low) | (c("h") > high) | ((c("value") >= dominant) & (c("value") < 100) & (c("components") != components))
    fit = F.when(c("components").isNull() | c("w").isNull() | c("h").isNull(), "uncertain").when(bad, "reject").when(c("components") == components, "pass").otherwise("uncertain")
    rows = rows.withColumn("fit", fit)
    ok = c("plausible")
    gate = (
        F.when(c("misread"), "misread")
        .when(c("substep") & (c("fit") != "reject") & F.coalesce(ok, F.lit(True)), "substep")
        .when(~F.coalesce(ok, F.lit(True)) | (c("fit") == "reject"), "noise")
        .when((c("fit") == "pass") & F.coalesce(ok, F.lit(False)), "accepted")
        .otherwise("human_review")
    )
    return rows.select(SET, "page", "value", "fit", gate.alias("decision"))


def slot_sequence(crops: DataFrame, most_islands: int = 3) -> DataFrame:
    """slots of each crop (qty array, saved array<int> of slot indices, islands): quantities, else saved labels, else islands.

    At most ``most_islands`` islands make slots; where there are more islands than slots, the rest is appended.
    """
    size = lambda c: F.coalesce(F.when(F.size(c) > 0, F.size(c)), F.lit(0))
    saved = F.coalesce(F.array_max(F.filter("saved", lambda k: k >= 0)) + 1, F.lit(0))
    island = F.when(F.col("islands") <= most_islands, F.col("islands")).otherwise(0)
    first = F.when(size("qty") > 0, size("qty")).otherwise(saved)
    source = F.when(size("qty") > 0, "qty").when(saved > 0, "saved_label").otherwise("island_fallback")
    rows = crops.withColumn("n", F.greatest(first, island)).withColumn("first", first).withColumn("source", source).filter("n > 0")
    return rows.select("crop", "first", "source", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot")).select("crop", "slot", F.when(F.col("slot") < F.col("first"), F.col("source")).otherwise("island_fallback").alias("source"))

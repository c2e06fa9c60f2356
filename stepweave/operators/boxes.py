"""Spatial joins, suppression and grouping of tokens and boxes on pages.

Boxes are x, y, w, h in pixels. Pairs are formed by page, and by page and grid cell where a page may be crowded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from stepweave.functions import scalars as s
from stepweave.operators.grouped import fold_groups

PAGE = "page"


def _side(df: DataFrame, prefix: str, columns: tuple[str, ...] = ("box", "x", "y", "w", "h", "text")) -> DataFrame:
    return df.select(PAGE, *(F.col(c).alias(f"{prefix}{c}") for c in columns if c in df.columns))


def nearby_qty(elements: DataFrame, tokens: DataFrame, k: int = 3, cell: int = 256) -> DataFrame:
    """For each element token the best quantity tokens above it: dy in [-8, 60], dx up to max(70, 3w); has-x first, then |dy - 14|, dx.

    Both sides are dealt into page and vertical cells; an element asks the cells its window reaches.
    """
    e = _side(elements, "e_").withColumn("cell", F.explode(F.expr(f"sequence(floor((e_y - 60) / {cell}), floor((e_y + 8) / {cell}))")))
    t = _side(tokens, "q_").withColumn("qty", s.parse_qty(F.col("q_text"))).filter("qty IS NOT NULL").withColumn("cell", F.floor(F.col("q_y") / cell))
    dy = F.col("e_y") - F.col("q_y")
    dx = F.abs((F.col("e_x") + F.col("e_w") / 2) - (F.col("q_x") + F.col("q_w") / 2))
    rows = e.join(t, [PAGE, "cell"]).withColumn("dy", dy).withColumn("dx", dx).filter((F.col("dy") >= -8) & (F.col("dy") <= 60) & (F.col("dx") <= F.greatest(F.lit(70.0), F.col("e_w") * 3.0)))
    w = Window.partitionBy(PAGE, "e_box").orderBy(F.when(F.contains(F.lower("q_text"), F.lit("x")), 0).otherwise(1), F.abs(F.col("dy") - 14), "dx", "q_box")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(PAGE, F.col("e_box").alias("box"), "rank", F.col("q_box").alias("qty_box"), "qty")


def nearest_step_box(crops: DataFrame, steps: DataFrame) -> DataFrame:
    """The step box of the page with the least |dx| + 1.5 |dy| between integer centres; the first by id on ties."""
    c, t = _side(crops, "c_"), _side(steps, "t_")
    mid = lambda p, a, b: F.floor(F.col(f"{p}{a}") + F.col(f"{p}{b}") / 2)
    score = F.abs(mid("c_", "x", "w") - mid("t_", "x", "w")) + 1.5 * F.abs(mid("c_", "y", "h") - mid("t_", "y", "h"))
    best = c.join(t, PAGE).groupBy(PAGE, "c_box").agg(F.min(F.struct(score.alias("score"), F.col("t_box").alias("step_box"))).alias("b"))
    return best.select(PAGE, F.col("c_box").alias("box"), "b.step_box", F.col("b.score").alias("score"))


def nearest_island(tokens: DataFrame, islands: DataFrame) -> DataFrame:
    """The island with the least squared distance between box centres; the first ordinal wins ties."""
    t, i = _side(tokens, "t_"), _side(islands, "i_")
    mid = lambda p, a, b: F.col(f"{p}{a}") + F.col(f"{p}{b}") / 2
    dx, dy = mid("t_", "x", "w") - mid("i_", "x", "w"), mid("t_", "y", "h") - mid("i_", "y", "h")
    best = t.join(i, PAGE).groupBy(PAGE, "t_box").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col("i_box").alias("island"))).alias("b"))
    return best.select(PAGE, F.col("t_box").alias("box"), "b.island")


def island_binding(slots: DataFrame, verdicts: DataFrame, nearest: DataFrame, ordinal: DataFrame) -> DataFrame:
    """Island of each slot: preset, else a person's verdict, else the nearest, else the ordinal one."""
    rows = slots.join(verdicts.select(PAGE, "box", F.col("island").alias("v")), [PAGE, "box"], "left").join(nearest.select(PAGE, "box", F.col("island").alias("n")), [PAGE, "box"], "left").join(ordinal.select(PAGE, "box", F.col("island").alias("o")), [PAGE, "box"], "left")
    source = F.when(F.col("preset").isNotNull(), "preset").when(F.col("v").isNotNull(), "verdict").when(F.col("n").isNotNull(), "nearest").when(F.col("o").isNotNull(), "ordinal").otherwise("none")
    return rows.select(PAGE, "box", F.coalesce("preset", "v", "n", "o").alias("island"), source.alias("source"))


def box_overlaps(left: DataFrame, right: DataFrame, cell: int = 512) -> DataFrame:
    """Pairs of boxes of a page that share more than an edge, with the shared area and IoU.

    Boxes are dealt to the grid cells they touch; a pair is reported in the cell of its shared corner only.
    """
    grid = lambda p: (F.explode(F.expr(f"sequence(floor({p}x / {cell}), floor(({p}x + {p}w - 1) / {cell}))")), F.explode(F.expr(f"sequence(floor({p}y / {cell}), floor(({p}y + {p}h - 1) / {cell}))")))
    a, b = _side(left, "a_"), _side(right, "b_")
    ax, ay = grid("a_")
    bx, by = grid("b_")
    rows = a.withColumn("gx", ax).withColumn("gy", ay).join(b.withColumn("gx", bx).withColumn("gy", by), [PAGE, "gx", "gy"])
    corner = (F.floor(F.greatest("a_x", "b_x") / cell) == F.col("gx")) & (F.floor(F.greatest("a_y", "b_y") / cell) == F.col("gy"))
    return rows.filter(s.overlaps("a_", "b_") & corner).select(PAGE, F.col("a_box").alias("left_box"), F.col("b_box").alias("right_box"), s.intersection_area("a_", "b_").alias("shared"), s.iou("a_", "b_").alias("iou"))


def _by_page(rows: DataFrame, columns: list[str], keep: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Order-dependent rules: the rows of one page at a time."""
    lean = rows.select(*columns)
    return fold_groups(lean, PAGE, ["box"], lambda items: keep(list(items)), lean.schema)


class Grid:
    """Numbered regions of a page in square cells: which of them may touch another region."""

    def __init__(self, side: float) -> None:
        self.side, self.cells = max(side, 1.0), {}

    @classmethod
    def of(cls, items: list[dict]) -> Grid:
        """Cells as large as the boxes of the page are in the middle."""
        sizes = sorted(max(r["w"], r["h"]) for r in items)
        return cls(sizes[len(sizes) // 2] if sizes else 1)

    def _keys(self, region: tuple[float, float, float, float], kind: Any) -> list[tuple]:
        x0, x1, y0, y1 = (math.floor(v / self.side) for v in region)
        return [(kind, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def add(self, number: int, region: tuple[float, float, float, float], kind: Any = None) -> None:
        for key in self._keys(region, kind):
            self.cells.setdefault(key, set()).add(number)

    def remove(self, number: int, region: tuple[float, float, float, float], kind: Any = None) -> None:
        for key in self._keys(region, kind):
            self.cells[key].discard(number)

    def near(self, region: tuple[float, float, float, float], kind: Any = None) -> list[int]:
        """Numbers of all regions that share a cell with ``region``, ascending."""
        return sorted(set().union(*(self.cells.get(key, ()) for key in self._keys(region, kind))))


def _around(r: dict, dx: float, dy: float, box: bool = True) -> tuple[float, float, float, float]:
    """x and y ranges of a box, if ``box``, and of what lies ``dx`` and ``dy`` around its centre."""
    cx, cy = r["x"] + r["w"] / 2, r["y"] + r["h"] / 2
    x, y = (cx - dx, cx + dx), (cy - dy, cy + dy)
    return (min(r["x"], x[0]), max(r["x"] + r["w"], x[1]), min(r["y"], y[0]), max(r["y"] + r["h"], y[1])) if box else (*x, *y)


def greedy_assign(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """Quantity tokens in (y, x) order each take the best unused component: |dx| + 2 |dy| between centres, none that lies clearly below.

    Components enter cells once a token comes that they don't lie below; a token looks at rings of cells around it until no further one can
    hold a better component.
    """

    def assign(page: Iterator[dict]) -> list[dict]:
        items = list(page)
        parts = [p for p in items if not p["asks"]]
        side = Grid.of(items).side
        spot = lambda x, y: (math.floor(x / side), math.floor(y / side))
        free: dict[tuple[int, int], dict[int, dict]] = {}
        falling = sorted(range(len(parts)), key=lambda n: -parts[n]["y"])
        out, left = [], 0
        for t in sorted((t for t in items if t["asks"]), key=lambda t: (t["y"], t["x"], t["box"])):
            while falling and parts[falling[-1]]["y"] <= t["y"] + 2 * t["h"]:
                n = falling.pop()
                free.setdefault(spot(parts[n]["x"] + parts[n]["w"] / 2, parts[n]["y"] + parts[n]["h"]), {})[n] = parts[n]
                left += 1
            tx, ty = t["x"] + t["w"] / 2, t["y"]
            cx, cy = spot(tx, ty)
            best, ring, seen = None, 0, 0
            while seen < left and (best is None or (ring - 1) * side <= best[0]):
                if 8 * ring > len(free):  # what is left lies in fewer cells than the ring has
                    cells = [c for c in free if max(abs(c[0] - cx), abs(c[1] - cy)) >= ring]
                    seen = left
                else:
                    cells = [(cx + i, cy + j) for i in range(-ring, ring + 1) for j in ((-ring, ring) if abs(i) < ring else range(-ring, ring + 1))]
                for cell in cells:
                    held = free.get(cell, {})
                    seen += len(held) if seen < left else 0
                    for n, p in held.items():
                        if p["y"] <= t["y"] + 2 * t["h"]:
                            score = abs(p["x"] + p["w"] / 2 - tx) + 2 * abs(p["y"] + p["h"] - ty)
                            if best is None or (score, n) < best[:2]:
                                best = score, n, cell
                ring += 1
            if best:
                p = free[best[2]].pop(best[1])
                if not free[best[2]]:
                    del free[best[2]]
                left -= 1
                out.append({"page": t["page"], "token": t["box"], "part": p["box"], "score": float(best[0])})
        return out

    c = [PAGE, "box", "x", "y", "w", "h"]
    both = tokens.select(*c, F.lit(True).alias("asks")).unionByName(parts.select(*c, F.lit(False).alias("asks")))
    return fold_groups(both, PAGE, ["box"], assign, "page long, token int, part int, score double")


def _iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    shared = max(w, 0) * max(h, 0)
    return shared / (a["w"] * a["h"] + b["w"] * b["h"] - shared) if shared else 0.0


def iou_dedupe(rows: DataFrame, near: float = 12.0, least: float = 0.25) -> DataFrame:
    """A row with the step of a kept one and a near centre, or with IoU of ``least``, replaces the first such if its score is higher."""

    def keep(items: list[dict]) -> list[dict]:
        kept: list[dict] = []
        grid = Grid.of(items)
        for r in sorted(items, key=lambda r: r["box"]):
            for i in grid.near(_around(r, near, near)):
                k = kept[i]
                close = abs(r["x"] + r["w"] / 2 - k["x"] - k["w"] / 2) <= near and abs(r["y"] + r["h"] / 2 - k["y"] - k["h"] / 2) <= near
                if (r["step"] == k["step"] and close) or _iou(r, k) >= least:
                    if r["score"] > k["score"]:
                        grid.remove(i, _around(k, near, near))
                        kept[i] = r
                        grid.add(i, _around(r, near, near))
                    break
            else:
                grid.add(len(kept), _around(r, near, near))
                kept.append(r)
        return kept

    return _by_page(rows, [PAGE, "box", "step", "x", "y", "w", "h", "score"], keep)


def nms_score(rows: DataFrame) -> DataFrame:
    """By falling score, rows of the visual source first, a row goes if a kept one has its centre within .8 heights and 1.2 widths."""

    def keep(items: list[dict]) -> list[dict]:
        kept: list[dict] = []
        grid = Grid.of(items)
        for r in sorted(items, key=lambda r: (-r["score"], r.get("source") != "visual", r["y"], r["x"], r["box"])):
            reach = _around(r, 1.2 * r["w"] + 1, 0.8 * r["h"] + 1, False)
            if not any(abs(r["y"] + r["h"] // 2 - k["y"] - k["h"] // 2) <= max(r["h"], k["h"]) * 0.8 and abs(r["x"] + r["w"] // 2 - k["x"] - k["w"] // 2) <= max(r["w"], k["w"]) * 1.2 for k in (kept[i] for i in grid.near(reach))):
                grid.add(len(kept), reach)
                kept.append(r)
        return kept

    return _by_page(rows, [PAGE, "box", "x", "y", "w", "h", "score", *(["source"] if "source" in rows.columns else [])], keep)


def nms_text(rows: DataFrame) -> DataFrame:
    """Of rows with equal text the best score stays where they overlap by .55 of the smaller area or lie within 4 pixels.

    A box without area overlaps any other by all of it.
    """

    def keep(items: list[dict]) -> list[dict]:
        kept: list[dict] = []
        grid, texts, flat = Grid.of(items), set(), set()
        for r in sorted(items, key=lambda r: (-r["score"], r["box"])):
            if r["text"] in flat or (r["text"] in texts and not r["w"] * r["h"]):
                continue
            for i in grid.near(_around(r, 4, 4), r["text"]):
                k = kept[i]
                w = min(r["x"] + r["w"], k["x"] + k["w"]) - max(r["x"], k["x"])
                h = min(r["y"] + r["h"], k["y"] + k["h"]) - max(r["y"], k["y"])
                dx, dy = r["x"] + r["w"] / 2 - k["x"] - k["w"] / 2, r["y"] + r["h"] / 2 - k["y"] - k["h"] / 2
                if max(w, 0) * max(h, 0) >= 0.55 * min(r["w"] * r["h"], k["w"] * k["h"]) or (dx * dx + dy * dy) ** 0.5 <= 4:
                    break
            else:
                grid.add(len(kept), _around(r, 4, 4), r["text"])
                kept.append(r)
                texts.add(r["text"])
                if not r["w"] * r["h"]:
                    flat.add(r["text"])
        return kept

    return _by_page(rows, [PAGE, "box", "text", "x", "y", "w", "h", "score"], keep)


def merge_nearby(rows: DataFrame, gap: int = 12, image_area: int = 800 * 1000, share: float = 0.36) -> DataFrame:
    """Boxes within ``gap`` merge again and again while the union stays under ``share`` of the image.

    Of all pairs that may merge, the one whose first box comes first goes, then the one whose second does; the union takes the
    first one's place. After a merge only the union's own pairs are new, so no pair is looked at twice without need.
    """

    def union(a: dict, b: dict) -> dict | None:
        if max(a["x"], b["x"]) - min(a["x"] + a["w"], b["x"] + b["w"]) > gap or max(a["y"], b["y"]) - min(a["y"] + a["h"], b["y"] + b["h"]) > gap:
            return None
        x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
        w, h = max(a["x"] + a["w"], b["x"] + b["w"]) - x, max(a["y"] + a["h"], b["y"] + b["h"]) - y
        return a | {"x": x, "y": y, "w": w, "h": h} if w * h <= share * image_area else None

    def keep(items: list[dict]) -> list[dict]:
        boxes, i = sorted(items, key=lambda r: r["box"]), 0
        while i < len(boxes):
            made = None
            for j in range(i + 1, len(boxes)):
                made = union(boxes[i], boxes[j])
                if made:
                    boxes[i] = made
                    del boxes[j]
                    break
            if not made:
                i += 1
                continue
            k = 0
            while k < i:  # earlier boxes met everything but the new union
                made = union(boxes[k], boxes[i])
                if made:
                    boxes[k] = made
                    del boxes[i]
                    i, k = k, -1
                k += 1
        return boxes

    return _by_page(rows, [PAGE, "box", "x", "y", "w", "h"], keep)


def row_grouping(tokens: DataFrame, slack: float = 18.0) -> DataFrame:
    """Tokens by centre height join the row whose running mean is within ``slack``, else start one."""
    def group(items: Iterator[dict]) -> list[dict]:
        means: list[list[float]] = []
        for r in (ordered := sorted(items, key=lambda r: (r["y"] + r["h"] / 2, r["x"], r["box"]))):
            c = r["y"] + r["h"] / 2
            k = next((i for i, m in enumerate(means) if abs(c - m[0]) <= slack), None)
            if k is None:
                means.append([c, 1])
                k = len(means) - 1
            else:
                m = means[k]
                m[0], m[1] = (m[0] * m[1] + c) / (m[1] + 1), m[1] + 1
            r["row"] = k + 1
        return ordered

    lean = tokens.select(PAGE, "box", "x", "y", "w", "h")
    return fold_groups(lean, PAGE, ["box"], group, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema) + ", row int")


def adjacent_join(tokens: DataFrame, gap: int = 14) -> DataFrame:
    """Digit tokens that follow each other on a line (centres within half a height, gap up to ``gap``) become one token."""
    w = Window.partitionBy(PAGE).orderBy("y", "x", "box")
    before = lambda c: F.lag(c).over(w)
    apart = F.col("x") - (before("x") + before("w"))
    same = (F.abs((F.col("y") + F.col("h") / 2) - (before("y") + before("h") / 2)) <= 0.5 * F.greatest(F.col("h"), before("h"))) & apart.between(-4, gap)
    rows = tokens.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("group", F.sum("fresh").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "box", "text"))), lambda t: t["text"]), "")
    agg = rows.groupBy(PAGE, "group").agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"), F.count("*").alias("parts"))
    return agg.select(PAGE, "group", "text", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"), "parts")


def valid_step_number(value: Column, limit: int = 200) -> Column:
    """struct(value, reason): numbers not above 0, of 1000 or more, or above ``limit`` are null with their own reason."""
    reason = F.when(value.isNull(), "missing").when(value <= 0, "not positive").when(value >= 1000, "four digits").when(value > limit, "above limit")
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def page_medians(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(PAGE).agg(F.median("h").alias("median_h"), F.median(F.col("w") * F.col("h")).alias("median_area"))


def valid_step_region(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """Tokens in the left 45 % and upper 88 % that reach 1.15 of the page's median height or 1.4 of its median area."""
    rows = tokens.join(page_medians(tokens), PAGE)
    return rows.filter((F.col("x") < width * 0.45) & (F.col("y") < height * 0.88) & ((F.col("h") >= F.col("median_h") * 1.15) | (F.col("w") * F.col("h") >= F.col("median_area") * 1.4)))


def page_number_token(x: Column, y: Column, width: int, height: int) -> Column:
    """In the lower left or right corner, 18 % wide and 12 % high."""
    return (y >= height * 0.88) & ((x <= width * 0.18) | (x >= width * 0.82))


def step_candidate_score(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """height and area against the page's medians (up to 3 each), left and upper position, minus .5 for a plain reading."""
    rows = tokens.join(page_medians(tokens), PAGE)
    part = lambda v, m: F.when(m > 0, F.least(F.lit(3.0), v / m)).otherwise(0.0)
    score = part(F.col("h"), F.col("median_h")) + part(F.col("w") * F.col("h"), F.col("median_area")) + F.greatest(F.lit(0.0), 2.0 - F.col("x") / max(1.0, width * 0.16)) + F.greatest(F.lit(0.0), 1.25 - F.col("y") / max(1.0, height * 0.88)) - 0.5
    return rows.withColumn("score", F.bround(score + 1e-9, 3)).drop("median_h", "median_area")  # a tie in decimals goes up


def main_sub_split(candidates: DataFrame, width: int) -> DataFrame:
    """In the leftmost band large or high-scoring candidates are main steps; others in the left 35 % are sub-steps."""
    w = Window.partitionBy(PAGE)
    margin = max(60, int(width * 0.04))
    rows = candidates.withColumn("area", F.col("w") * F.col("h")).withColumn("band", F.col("x") <= F.min("x").over(w) + margin)
    rows = rows.withColumn("top_area", F.max(F.when(F.col("band"), F.col("area"))).over(w)).withColumn("top_score", F.max(F.when(F.col("band"), F.col("score"))).over(w))
    main = F.col("band") & ((F.col("area") >= F.col("top_area") * 0.55) | (F.col("score") >= F.col("top_score") - 0.75))
    role = F.when(main, "main").when(F.col("x") <= int(width * 0.35), "sub")
    return rows.withColumn("role", role).filter("role IS NOT NULL").select(PAGE, "box", "role")


def ocr_vote(votes: DataFrame) -> DataFrame:
    """The winning value of each key: best confidence + 4 for each further vote + 40 for each further digit of its best text."""
    by_value = votes.groupBy("key", "value").agg(F.count("*").alias("n"), F.max("confidence").alias("best"), F.max_by("text", F.struct("confidence", "text")).alias("text"))
    total = F.col("best") + 4.0 * (F.col("n") - 1) + 40.0 * (F.length("text") - 1)
    ranked = by_value.withColumn("total", total)
    best = ranked.groupBy("key").agg(F.max(F.struct("total", "best", F.length("text").alias("digits"), "n", F.col("value").alias("value"), "text")).alias("b"))
    return best.select("key", "b.value", "b.text", "b.total")


def median_band(rows: DataFrame, group: str, value: str, band: float = 0.3) -> DataFrame:
    """Median of each group, the band around it, and which values lie outside."""
    mid = rows.groupBy(F.col(group).alias("_g")).agg(F.median(value).alias("median"))
    out = rows.join(mid, F.col(group) == F.col("_g")).drop("_g")
    return out.withColumn("outlier", (F.col(value) < F.col("median") * (1 - band)) | (F.col(value) > F.col("median") * (1 + band))).withColumn("narrow", F.col(value) < F.col("median") - 10)


def signal_profile(rows: DataFrame, group: str, signals: list[str]) -> DataFrame:
    """Minimum, median and maximum of each signal in each class."""
    long = rows.select(F.col(group).alias("class"), *(F.col(c).cast("double").alias(c) for c in signals)).unpivot(["class"], signals, "signal", "value")
    return long.groupBy("class", "signal").agg(F.min("value").alias("low"), F.median("value").alias("median"), F.max("value").alias("high"))


def overview_spread(tokens: DataFrame, number: str, gap: int = 100) -> DataFrame:
    """Distinct numbers of a page, their spread in x and y, and the count of vertical bands further apart than ``gap``."""
    w = Window.partitionBy(PAGE).orderBy("y", "box")
    rows = tokens.withColumn("step", (F.col("y") - F.lag("y").over(w) > gap).cast("int"))
    return rows.groupBy(PAGE).agg(F.countDistinct(number).alias("numbers"), (F.max("x") - F.min("x")).alias("x_spread"), (F.max("y") - F.min("y")).alias("y_spread"), (F.coalesce(F.sum("step"), F.lit(0)) + 1).alias("bands"))


def overview_pages(tokens: DataFrame, number: str, width: int, height: int) -> DataFrame:
    """Whether a page shows several sections at once, by the spread of its number tokens' centres.

    Bands are runs of centres no further apart than 12 % of the page. Of four tokens or more, two numbers over 35 % of the width
    and 10 % of the height in two bands either way are enough, as are four numbers over 45 % and 15 % in two bands both ways.
    """
    rows = tokens.select(PAGE, F.col(number).alias("number"), (F.col("x") + F.col("w") * 0.5).alias("cx"), (F.col("y") + F.col("h") * 0.5).alias("cy"))
    step = lambda c, size: (F.col(c) - F.lag(c).over(Window.partitionBy(PAGE).orderBy(c)) > size * 0.12).cast("int")
    rows = rows.withColumns({"sx": step("cx", width), "sy": step("cy", height)})
    spread = rows.groupBy(PAGE).agg(F.count("*").alias("tokens"), F.countDistinct("number").alias("numbers"), (F.max("cx") - F.min("cx")).alias("x_spread"), (F.max("cy") - F.min("cy")).alias("y_spread"), (F.coalesce(F.sum("sx"), F.lit(0)) + 1).alias("x_bands"), (F.coalesce(F.sum("sy"), F.lit(0)) + 1).alias("y_bands"))
    c = F.col
    some = (c("numbers") >= 2) & (c("x_spread") >= width * 0.35) & (c("y_spread") >= height * 0.10) & ((c("x_bands") >= 2) | (c("y_bands") >= 2))
    many = (c("numbers") >= 4) & (c("x_spread") >= width * 0.45) & (c("y_spread") >= height * 0.15) & (c("x_bands") >= 2) & (c("y_bands") >= 2)
    return spread.withColumn("overview", (c("tokens") >= 4) & (some | many))


def visual_order(boxes: DataFrame) -> DataFrame:
    """Reading order of a page's boxes."""
    return boxes.withColumn("nth", F.row_number().over(Window.partitionBy(PAGE).orderBy("y", "x", "box")))


def best_detection(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of each key with the greatest (score, area, width)."""
    return rows.groupBy(*keys).agg(F.max(F.struct("score", (F.col("w") * F.col("h")).alias("area"), "w", "box")).alias("b")).select(*keys, "b.box", "b.score")


def even_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` evenly spaced members of each group, ends included; all of a smaller group."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("nth", F.row_number().over(w.orderBy(order)) - 1).withColumn("size", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("size") - 1) / F.lit(max(n - 1, 1)), 0).cast("int"))
    return ranked.filter((F.col("size") <= n) | F.array_contains(picks, F.col("nth"))).drop("nth", "size")

"""Feature jobs over image tables: (id, height, width, channels, data), as Spark's image source gives them (BGR or BGRA bytes by row).

Every job is one narrow ``mapInArrow`` pass; images that are null or too short for their shape give null features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def _each(images: DataFrame, schema: str, rule: Callable[[np.ndarray], list[dict]], extra: tuple[str, ...] = ()) -> DataFrame:
    """``rule`` of each image array (height, width, channels) to rows; ``extra`` columns are passed to it by name."""
    lead = images.schema["id"].dataType.simpleString()
    out = _parse_datatype_string(f"id {lead}, {schema}")
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(lo, 64).to_pylist():
                    size = (r["height"] or 0) * (r["width"] or 0) * (r["channels"] or 0)
                    good = r["data"] is not None and size and len(r["data"]) >= size
                    pixels = np.frombuffer(r["data"], np.uint8, size).reshape(r["height"], r["width"], r["channels"]) if good else None
                    rows += [{"id": r["id"], **x} for x in (rule(pixels, *(r[e] for e in extra)) if good else [{}])]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return images.select("id", "height", "width", "channels", "data", *extra).mapInArrow(run, out)


def _gray(p: np.ndarray) -> np.ndarray:
    if p.shape[2] == 1:
        return p[:, :, 0].astype(float)
    return p[:, :, 0] * 0.114 + p[:, :, 1] * 0.587 + p[:, :, 2] * 0.299


#: fixed values: grey levels of bright pixels, widest image before it shrinks, gradients of weak and of strong edges
BRIGHT, WIDEST, WEAK, STRONG = 210, 1_400, 80, 160


def _resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey image of another size, each new pixel the rounded mean of the area that it covers."""
    for axis, new in ((0, height), (1, width)):
        size = g.shape[axis]
        sums = np.concatenate([np.zeros_like(g.take([0], axis)), g.cumsum(axis)], axis)
        at = np.linspace(0, size, new + 1)
        low = np.minimum(at.astype(int), size - 1)
        part = np.expand_dims(at - low, 1 - axis)
        g = np.diff(sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part, axis=axis) * new / size
    return np.floor(g + 0.5)


def _shrunk(g: np.ndarray, most: int = WIDEST) -> np.ndarray:
    """A grey image no wider than ``most``."""
    height, width = g.shape
    return g if width <= most else _resized(g, max(1, int(height * (most / width))), most)


def edges(g: np.ndarray, weak: int = WEAK, strong: int = STRONG) -> np.ndarray:
    """Thin edges of a whole-number grey image.

    The gradient is that of 3 x 3 smoothed differences with repeated borders, its size the sum of both parts. A pixel over ``weak`` is a
    crest if its size exceeds the neighbour's before it along the gradient's direction (level, upright or either diagonal, parted at 22.5
    degrees) and is not below the one after it, on diagonals exceeds both; outside the image sizes are 0. Crests that touch, over
    any of eight neighbours, one over ``strong`` are edges.
    """
    height, width = g.shape
    p = np.pad(g.astype(np.int64), 1, mode="edge")
    down, right = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = down[:, 2:] - down[:, :-2], right[2:] - right[:-2]
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)
    at = lambda y, x: around[1 + y : 1 + y + height, 1 + x : 1 + x + width]
    flat = np.abs(dx) * np.tan(np.pi / 8)
    level, upright = np.abs(dy) < flat, np.abs(dy) > flat + 2 * np.abs(dx)  # the tangent of 67.5 degrees is 2 more
    crest = np.where(level, (size > at(0, -1)) & (size >= at(0, 1)), np.where(upright, (size > at(-1, 0)) & (size >= at(1, 0)), np.where((dx < 0) != (dy < 0), (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    crest &= size > weak
    label = _components(crest)
    return crest & np.isin(label, np.unique(label[crest & (size > strong)]))


def layout_signals(images: DataFrame) -> DataFrame:
    """Share of bright pixels and of edge pixels of the grey image, at most WIDEST pixels wide."""

    def rule(p: np.ndarray) -> list[dict]:
        g = _shrunk(np.floor(_gray(p) + 0.5))
        return [{"bright_ratio": float((g > BRIGHT).mean()), "edge_density": float(edges(g).mean())}]

    return _each(images, "bright_ratio double, edge_density double", rule)


#: fixed values: side and edge limits of images that are compared, and the weight of contours
SIDE, FAINT, CLEAR, CONTOURS = 96, 60, 160, 250.0


def shape_features(images: DataFrame) -> DataFrame:
    """(id, edge_density, quadrants, contours) of each image at SIDE x SIDE: edges all over and in each quarter, and borders of edge shapes.

    A border is the outline of a shape of touching edge pixels or of a hole in one.
    """

    def rule(p: np.ndarray) -> list[dict]:
        e = edges(_resized(np.floor(_gray(p) + 0.5), SIDE, SIDE), FAINT, CLEAR)
        half = SIDE // 2
        holes = int(_components(np.pad(~e, 1, constant_values=True), False).max()) - 1
        quarters = [float(e[y : y + half, x : x + half].mean()) for y in (0, half) for x in (0, half)]
        return [{"edge_density": float(e.mean()), "quadrants": quarters, "contours": int(_components(e).max()) + holes}]

    return _each(images, "edge_density double, quadrants array<double>, contours int", rule)


def shape_difference(a: str, b: str) -> Column:
    """Mean of the differences of edge density, of its quarters and of the density of contours; null without both images' features."""
    density = F.abs(F.col(f"{a}.edge_density") - F.col(f"{b}.edge_density"))
    quarters = F.aggregate(F.zip_with(f"{a}.quadrants", f"{b}.quadrants", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / 4
    contours = F.abs(F.col(f"{a}.contours") - F.col(f"{b}.contours")) / F.lit(float(SIDE * SIDE)) * CONTOURS
    return (density + quarters + contours) / 3


def image_differences(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``pairs`` (crop, image: ids of ``features``, and other columns) with their ``difference``; pairs without both features are dropped."""
    side = lambda name: features.select(F.col("id").alias(name), F.struct("edge_density", "quadrants", "contours").alias(f"{name}_shape"))
    met = pairs.join(side("crop"), "crop").join(side("image"), "image")
    return met.withColumn("difference", shape_difference("crop_shape", "image_shape")).filter("difference IS NOT NULL").drop("crop_shape", "image_shape")


def top_band(images: DataFrame) -> DataFrame:
    """White, warm and dark shares of the top 35 %, and whether the page goes on to costlier stages (also if unreadable)."""

    def rule(p: np.ndarray) -> list[dict]:
        t = p[: max(1, round(p.shape[0] * 0.35))].astype(float)
        g = _gray(t)
        b, gr, r = (t[:, :, min(k, t.shape[2] - 1)] for k in range(3))
        high, low = np.maximum(np.maximum(b, gr), r), np.minimum(np.minimum(b, gr), r)
        warm = (r == high) & (r > b) & (high >= 140) & ((high - low) * 255 >= 70 * np.maximum(high, 1))
        white, warmth = float((g >= 225).mean()), float(warm.mean())
        return [{"white": round(white, 4), "warm": round(warmth, 4), "dark": round(float((g <= 95).mean()), 4), "passes": white > 0.35 or warmth > 0.002}]

    return _each(images, "white double, warm double, dark double, passes boolean", rule).na.fill(True, ["passes"])


def _hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (half degrees), saturation and value of rows of blue, green and red."""
    b, g, r = bgr.T
    top, span = bgr.max(1), bgr.max(1) - bgr.min(1)
    safe = np.maximum(span, 1)
    sector = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span > 0, np.rint(30 * sector) % 180, 0).astype(int)
    return hue, np.rint(255 * span / np.maximum(top, 1)).astype(int), top


def dominant_colour(images: DataFrame) -> DataFrame:
    """Median colour of likely part pixels (saturated or of middle value, not pale blue, near white or dark); of all if there are none.

    Hue goes from 0 to 179, saturation and value from 0 to 255.
    """

    def rule(p: np.ndarray) -> list[dict]:
        flat = p.reshape(-1, p.shape[2])[:, :3].astype(int)
        if flat.shape[1] < 3:
            flat = np.repeat(flat[:, :1], 3, 1)
        hue, sat, val = _hsv(flat)
        # fixed values: bounds of part pixels and of what surrounds them
        part = ((sat >= 42) & (val >= 52)) | ((val >= 68) & (val <= 188))
        pale_blue = (hue >= 82) & (hue <= 132) & (sat <= 140) & (val >= 150)
        keep = part & ~pale_blue & ~((sat <= 36) & (val >= 205)) & ~((val <= 58) & (sat <= 95))
        mid = np.median(flat[keep] if keep.any() else flat, axis=0)
        return [{"b": int(mid[0]), "g": int(mid[1]), "r": int(mid[2])}]

    return _each(images, "b int, g int, r int", rule)


def foreground_stats(images: DataFrame, floor: int = 16) -> DataFrame:
    """Count, mean colour, box, density and aspect of pixels whose last channel is above ``floor``."""

    def rule(p: np.ndarray) -> list[dict]:
        mask = p[:, :, -1] > floor
        if not mask.any():
            return [{"pixels": 0, "density": 0.0}]
        ys, xs = np.nonzero(mask)
        w, h = int(xs.max() - xs.min()) + 1, int(ys.max() - ys.min()) + 1
        mean = np.floor(p[mask].astype(float).mean(0) + 0.5)
        return [{"pixels": int(mask.sum()), "mean": [int(v) for v in mean], "x": int(xs.min()), "y": int(ys.min()), "w": w, "h": h, "density": round(float(mask.sum()) / (w * h), 4), "aspect": round(w / h, 4)}]

    return _each(images, "pixels int, mean array<int>, x int, y int, w int, h int, density double, aspect double", rule)


def _components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels of components, 8-connected or else 4-connected, 1 and up in reading order of their first pixel.

    Runs of each row are joined with those of the row above that they touch; only runs are looped over, never pixels.
    """
    height, width = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, lo), hi = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    top = list(range(len(rows)))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    start = np.searchsorted(rows, np.arange(height + 1))
    for y in range(1, height):
        above, here = range(start[y - 1], start[y]), start[y]
        for k in above:
            while here < start[y + 1] and hi[here] < lo[k] + (not diagonal):
                here += 1
            at = here
            while at < start[y + 1] and lo[at] <= hi[k] - (not diagonal):
                a, b = find(k), find(at)
                top[max(a, b)] = min(a, b)
                at += 1
    roots = np.array([find(k) for k in range(len(rows))], np.int64)
    _, number = np.unique(roots, return_inverse=True)
    label = np.zeros((height, width + 1), np.int64)
    np.add.at(label, (rows, lo), number + 1)
    np.add.at(label, (rows, hi), -(number + 1))
    return label.cumsum(1)[:, :width]


def mask_islands(images: DataFrame, least: int = 400, share: float = 0.08) -> DataFrame:
    """8-connected islands of the first channel with box, area, fill and centroid; those of max(``least``, ``share`` of the largest)."""

    def rule(p: np.ndarray) -> list[dict]:
        label = _components(p[:, :, 0] > 0)
        ys, xs = np.nonzero(label)
        k = label[ys, xs]
        n = int(label.max()) + 1
        area, far = np.bincount(k, minlength=n), np.iinfo(np.int64).max
        x1, y1, x2, y2 = np.full(n, far), np.full(n, far), np.zeros(n, int), np.zeros(n, int)
        for side, at, which in ((x1, xs, np.minimum), (y1, ys, np.minimum), (x2, xs, np.maximum), (y2, ys, np.maximum)):
            which.at(side, k, at)
        cx, cy = np.bincount(k, xs, n), np.bincount(k, ys, n)
        out = []
        for i in range(1, n):
            w, h = int(x2[i] - x1[i]) + 1, int(y2[i] - y1[i]) + 1
            out.append({"island": i, "x": int(x1[i]), "y": int(y1[i]), "w": w, "h": h, "area": int(area[i]), "fill": round(int(area[i]) / (w * h), 4), "cx": round(float(cx[i] / area[i]), 2), "cy": round(float(cy[i] / area[i]), 2)})
        top = max((r["area"] for r in out), default=0)
        return [r for r in out if r["area"] >= max(least, share * top)]

    return _each(images, "island int, x int, y int, w int, h int, area int, fill double, cx double, cy double", rule)


def mask_stats(images: DataFrame, floor: int = 127, cap: int = 210, least: int = 20, relaxed: int = 50) -> DataFrame:
    """Opaque pixels and their box, and median and mean red, green and blue of those over ``floor`` in the last channel and below ``cap`` in brightness.

    Where fewer than ``least`` remain, all pixels over ``relaxed`` count.
    """

    def rule(p: np.ndarray) -> list[dict]:
        colour, alpha = p[:, :, :3].astype(float), p[:, :, -1]
        ys, xs = np.nonzero(alpha > 0)
        if not len(ys):
            return [{"pixels": 0}]
        colour = colour[:, :, ::-1]
        some = colour[(alpha > floor) & (p[:, :, :3].mean(2) < cap)]
        some = some if len(some) >= least else colour[alpha > relaxed]
        found = {"pixels": len(ys), "x": int(xs.min()), "y": int(ys.min()), "w": int(xs.max() - xs.min()) + 1, "h": int(ys.max() - ys.min()) + 1}
        return [found | ({"median": [int(v) for v in np.median(some, 0)], "mean": [int(v) for v in some.mean(0)]} if len(some) else {})]

    return _each(images, "pixels int, x int, y int, w int, h int, median array<int>, mean array<int>", rule)


def _spread(mask: np.ndarray, shape: list[str], most: bool) -> np.ndarray:
    """Dilation (``most``) or erosion by a small shape; beyond the image nothing counts."""
    reach = len(shape) // 2
    wide = np.pad(mask, reach, constant_values=not most)
    found = [wide[y : y + mask.shape[0], x : x + mask.shape[1]] for y, row in enumerate(shape) for x, v in enumerate(row) if v == "1"]
    return np.logical_or.reduce(found) if most else np.logical_and.reduce(found)


# fixed values: round shapes of 5 and 3 pixels
_ROUND5, _ROUND3 = ["00100", "11111", "11111", "11111", "00100"], ["010", "111", "010"]


def crop_normalize(images: DataFrame, least: int = 96, pad: float = 0.12, least_pad: int = 8) -> DataFrame:
    """(height, width, channels, data): the foreground of a blue, green, red crop on a white square of at least ``least`` pixels a side.

    Foreground is what isn't pale blue, closed twice and opened once, without components below 40 pixels or .25 % of the
    image (all of it if none is larger). Its box is padded by ``pad`` of its longer side, ``least_pad`` at least, within the
    image; all but the foreground is white.
    """

    def rule(p: np.ndarray) -> list[dict]:
        if p.shape[2] < 3:
            p = np.repeat(p[:, :, :1], 3, 2)
        p = p[:, :, :3]
        hue, sat, val = (v.reshape(p.shape[:2]) for v in _hsv(p.reshape(-1, 3).astype(int)))
        b, g, r = (p[:, :, k].astype(int) for k in range(3))
        # fixed values: two descriptions of a pale blue background
        mask = ~(((hue >= 80) & (hue <= 130) & (sat <= 150) & (val >= 135)) | ((b >= 150) & (g >= 150) & (r >= 130) & (b - r >= 8)))
        for shape, most in [(_ROUND5, True)] * 2 + [(_ROUND5, False)] * 2 + [(_ROUND3, False), (_ROUND3, True)]:
            mask = _spread(mask, shape, most)
        label = _components(mask)
        large = mask & (np.bincount(label.ravel())[label] >= max(40, int(mask.size * 0.0025)))
        mask = large if large.any() else mask
        ys, xs = np.nonzero(mask)
        y1, x1, y2, x2 = (ys.min(), xs.min(), ys.max() + 1, xs.max() + 1) if len(ys) else (0, 0, *mask.shape)
        more = max(least_pad, round(max(y2 - y1, x2 - x1) * pad))
        y1, x1, y2, x2 = max(0, y1 - more), max(0, x1 - more), min(mask.shape[0], y2 + more), min(mask.shape[1], x2 + more)
        part = np.where(mask[y1:y2, x1:x2, None], p[y1:y2, x1:x2], 255).astype(np.uint8)
        h, w = part.shape[:2]
        side = max(h, w, least)
        out = np.full((side, side, 3), 255, np.uint8)
        y, x = (side - h) // 2, (side - w) // 2
        out[y : y + h, x : x + w] = part
        return [{"height": side, "width": side, "channels": 3, "data": out.tobytes()}]

    return _each(images, "height int, width int, channels int, data binary", rule)


def _boxes(label: np.ndarray) -> list[dict]:
    """Box and pixels of each component."""
    ys, xs = np.nonzero(label)
    k, n = label[ys, xs], int(label.max()) + 1
    low, high = np.full((2, n), 1 << 30), np.zeros((2, n), int)
    for side, at in enumerate((xs, ys)):
        np.minimum.at(low[side], k, at)
        np.maximum.at(high[side], k, at)
    size = np.bincount(k, minlength=n)
    return [{"x": int(low[0, i]), "y": int(low[1, i]), "w": int(high[0, i] - low[0, i]) + 1, "h": int(high[1, i] - low[1, i]) + 1, "pixels": int(size[i])} for i in range(1, n)]


def _joined(boxes: list[dict], gap: float = 0.6) -> list[dict]:
    """Digits side by side as one group: those on a line (half the lower height shared) at most ``gap`` heights apart."""
    groups: list[dict] = []
    for b in sorted(boxes, key=lambda b: (b["x"], b["y"])):
        for g in groups:
            shared = min(g["y"] + g["h"], b["y"] + b["h"]) - max(g["y"], b["y"])
            if shared >= 0.5 * min(g["h"], b["h"]) and b["x"] - (g["x"] + g["w"]) <= gap * max(g["h"], b["h"]):
                x2, y2 = max(g["x"] + g["w"], b["x"] + b["w"]), max(g["y"] + g["h"], b["y"] + b["h"])
                g["y"] = min(g["y"], b["y"])
                g["w"], g["h"], g["pixels"] = x2 - g["x"], y2 - g["y"], g["pixels"] + b["pixels"]
                break
        else:
            groups.append(dict(b))
    return groups


def page_structure(images: DataFrame, width: int = 420) -> DataFrame:
    """(arrows, dark, groups, strong, central, pixels): orange and dark components and number-like groups of a page.

    Pages are read at ``width`` pixels across. Groups are joined dark components of a digit's size above the lowest tenth, on a
    pale ground; strong ones are 30 high or of 300 pixels, central ones strong and in the middle 65 % of the page.
    """

    def rule(p: np.ndarray) -> list[dict]:
        height = max(1, round(p.shape[0] / max(1, p.shape[1]) * width))
        rows, cols = np.arange(height) * p.shape[0] // height, np.arange(width) * p.shape[1] // width
        q = np.repeat(p[:, :, :1], 3, 2) if p.shape[2] < 3 else p[:, :, :3]
        q = q[rows][:, cols].astype(int)
        b, g, r = q[:, :, 0], q[:, :, 1], q[:, :, 2]
        light, span = 0.299 * r + 0.587 * g + 0.114 * b, q.max(2) - q.min(2)
        # fixed values: colours of arrows, of print and of a label's ground, and sizes of digits
        dark = [c for c in _boxes(_components((light < 70) & (span < 95))) if c["pixels"] >= 20]
        orange = [c for c in _boxes(_components((r > 195) & (g > 45) & (g < 190) & (b < 150) & (r - g > 30))) if c["pixels"] >= 35 and c["w"] >= 8 and c["h"] >= 5 and c["y"] < height * 0.86]
        digits = [c for c in dark if c["y"] <= height * 0.90 and 14 <= c["h"] <= 90 and 5 <= c["w"] <= 115 and 0.10 <= c["w"] / c["h"] <= 3.6]
        pale = lambda c: float((light[max(0, c["y"] - 4) : c["y"] + c["h"] + 4, max(0, c["x"] - 4) : c["x"] + c["w"] + 4] >= 170).mean())
        groups = [c for c in _joined(digits) if c["h"] >= 18 and c["w"] >= 8 and 0.12 <= c["w"] / c["h"] <= 3.8 and pale(c) >= 0.22]
        strong = [c for c in groups if c["h"] >= 30 or c["pixels"] >= 300]
        central = [c for c in strong if 1 - min(1, abs(c["x"] + c["w"] / 2 - width / 2) / (width / 2)) >= 0.35]
        return [{"arrows": len(orange), "dark": len(dark), "groups": len(groups), "strong": len(strong), "central": len(central), "pixels": sum(c["pixels"] for c in groups)}]

    return _each(images, "arrows int, dark int, groups int, strong int, central int, pixels int", rule)


def structure_scores(signals: DataFrame, keep: int = 12) -> DataFrame:
    """Scores of pages (id, window, page, first, last, arrows, groups, strong, central, pixels) by their structure.

    ``score`` ranks the pages of a window, of which the best ``keep`` are listed; ``candidate_score`` and ``candidate`` judge a page
    alone. Both limits and weights are part of the rule.
    """
    c = F.col
    upto = lambda name, n: F.least(F.lit(1.0), c(name) / n)
    early = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("page") - c("first")) / F.greatest(F.lit(1), c("last") - c("first"))))
    score = F.when(c("arrows") > 0, 35 * upto("arrows", 2)).otherwise(-10.0) + F.when(c("strong") > 0, 28 * upto("strong", 2)).otherwise(-8.0) + 22 * upto("central", 1) + 12 * early + F.when(early <= 0.20, -6.0).otherwise(0.0)
    score = score + F.when((c("arrows") > 0) & (c("strong") > 0), 18.0).when((c("arrows") == 0) & (c("strong") == 0), -18.0).otherwise(0.0)
    alone = F.round(0.58 * upto("groups", 5) + 0.34 * upto("arrows", 3) + 0.08 * upto("pixels", 2400), 4)
    rows = signals.withColumns({"score": F.round(score, 3), "candidate_score": alone})
    rows = rows.withColumn("candidate", (c("groups") >= 2) & (c("arrows") >= 1) & (c("candidate_score") >= 0.42))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "page"))).filter(c("rank") <= keep)


def crop_extract(images: DataFrame, crops: DataFrame) -> DataFrame:
    """(id, crop, height, width, channels, data): boxes (id, crop, x, y, w, h) clamped to their page and cut out; empty ones are dropped."""
    joined = images.join(crops, "id").select("id", "height", "width", "channels", "data", F.struct("crop", "x", "y", "w", "h").alias("box"))

    def rule(p: np.ndarray, box: dict) -> list[dict]:
        x, y = max(0, box["x"]), max(0, box["y"])
        part = p[y : max(y, box["y"] + box["h"]), x : max(x, box["x"] + box["w"])]
        if not part.size:
            return []
        return [{"crop": box["crop"], "height": part.shape[0], "width": part.shape[1], "channels": part.shape[2], "data": part.tobytes()}]

    return _each(joined, "crop long, height int, width int, channels int, data binary", rule, ("box",))


def grid_images(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Vectors of side * side values as grey images, stretched to 0..255."""
    low, high = F.array_min("embedding"), F.array_max("embedding")
    gray = F.transform("embedding", lambda v: F.lpad(F.hex(F.least(F.lit(255), F.floor(255 * (v - low) / F.when(high > low, high - low).otherwise(1.0))).cast("long")), 2, "0"))
    return vectors.select(F.col("vec_id").alias("id"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(gray, "")).alias("data"))

"""Suppression and assignment with an index against loops over all kept boxes."""

import random
import time

import pytest

from stepweave.operators import boxes

KINDS = "page long, box int, step int, text string, source string, x int, y int, w int, h int, score double"


def page(seed, n, size, large=60):
    rng = random.Random(seed)
    return [(seed, k, rng.randint(1, 9), rng.choice("abc"), rng.choice(["visual", "text"]), rng.randint(0, size), rng.randint(0, size), rng.choice((0, 3, rng.randint(1, large))), rng.choice((0, 4, rng.randint(1, large))), rng.randint(0, 9) / 10) for k in range(n)]


def dicts(rows):
    names = [c.strip().split()[0] for c in KINDS.split(",")]
    return [dict(zip(names, r)) for r in rows]


def centre(r, half=2):
    return r["x"] + r["w"] / half, r["y"] + r["h"] / half


def overlap(a, b):
    return max(min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]), 0) * max(min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]), 0)


def plain_iou(items):
    kept = []
    for r in items:
        for i, k in enumerate(kept):
            (ax, ay), (bx, by), both = centre(r), centre(k), overlap(r, k)
            if (r["step"] == k["step"] and abs(ax - bx) <= 12 and abs(ay - by) <= 12) or (both and both / (r["w"] * r["h"] + k["w"] * k["h"] - both) >= 0.25):
                if r["score"] > k["score"]:
                    kept[i] = r
                break
        else:
            kept.append(r)
    return kept


def plain_score(items):
    kept = []
    for r in sorted(items, key=lambda r: (-r["score"], r["source"] != "visual", r["y"], r["x"], r["box"])):
        if not any(abs(r["y"] + r["h"] // 2 - k["y"] - k["h"] // 2) <= max(r["h"], k["h"]) * 0.8 and abs(r["x"] + r["w"] // 2 - k["x"] - k["w"] // 2) <= max(r["w"], k["w"]) * 1.2 for k in kept):
            kept.append(r)
    return kept


def plain_text(items):
    kept = []
    for r in sorted(items, key=lambda r: (-r["score"], r["box"])):
        def hit(k, r=r):
            (ax, ay), (bx, by) = centre(r), centre(k)
            return k["text"] == r["text"] and (overlap(r, k) >= 0.55 * min(r["w"] * r["h"], k["w"] * k["h"]) or ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 <= 4)
        if not any(map(hit, kept)):
            kept.append(r)
    return kept


def plain_assign(tokens, parts):
    free, out = list(parts), []
    for t in sorted(tokens, key=lambda t: (t["y"], t["x"], t["box"])):
        scored = [(abs(centre(p)[0] - centre(t)[0]) + 2 * abs(p["y"] + p["h"] - t["y"]), n) for n, p in enumerate(free) if p["y"] <= t["y"] + 2 * t["h"]]
        if scored:
            score, n = min(scored)
            out.append((t["page"], t["box"], free.pop(n)["box"], float(score)))
    return out


RULES = {"iou": (boxes.iou_dedupe, plain_iou), "score": (boxes.nms_score, plain_score), "text": (boxes.nms_text, plain_text)}


@pytest.mark.parametrize("name", RULES)
def test_suppression(spark, name):
    pages = [page(s, n, size) for s, (n, size) in enumerate([(1, 10), (60, 80), (200, 300), (150, 5), (200, 2_000), (90, 200)])]
    made, plain = RULES[name]
    got = {(r["page"], r["box"]) for r in made(spark.createDataFrame([r for p in pages for r in p], KINDS)).collect()}
    assert got == {(r["page"], r["box"]) for p in pages for r in plain(dicts(p))}


def test_assignment(spark):
    pages = [(page(s, n, size), page(s, m, size)) for s, (n, m, size) in enumerate([(5, 0, 9), (40, 40, 300), (90, 30, 1_000), (30, 120, 50), (200, 200, 3_000)])]
    frame = lambda k, lift: spark.createDataFrame([(r[0], r[1] + lift, *r[2:]) for p in pages for r in p[k]], KINDS)
    got = sorted((r["page"], r["token"], r["part"], r["score"]) for r in boxes.greedy_assign(frame(0, 1_000), frame(1, 0)).collect())
    want = []
    for tokens, parts in pages:
        want += plain_assign(dicts([(r[0], r[1] + 1_000, *r[2:]) for r in tokens]), dicts(parts))
    assert got == sorted(want)


def test_large_pages_take_time_in_proportion(spark):
    took = {}
    for n in (1_500, 6_000):
        df = spark.createDataFrame(page(1, n, int(40 * n**0.5), 30), KINDS).coalesce(1).cache()
        df.count()
        for name, (made, _) in RULES.items():
            began = time.perf_counter()
            made(df).count()
            took[name, n] = time.perf_counter() - began
        began = time.perf_counter()
        boxes.greedy_assign(df.filter("box % 2 = 0"), df.filter("box % 2 = 1")).count()
        took["assign", n] = time.perf_counter() - began
    assert all(took[name, 6_000] < 8 * took[name, 1_500] + 3 for name in (*RULES, "assign")), took

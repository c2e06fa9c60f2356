"""Edges and shrinking against loops over pixels."""

import math

import numpy as np
import pytest

from stepweave.operators import images


def plain_edges(g, weak, strong):
    h, w = g.shape
    px = lambda y, x: int(g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx, dy, size = {}, {}, {}
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (px(y + j, x + 1) - px(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (px(y + 1, x + j) - px(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            size[y, x] = abs(dx[y, x]) + abs(dy[y, x])
    crest = set()
    for (y, x), m in size.items():
        turn = math.degrees(math.atan2(abs(dy[y, x]), abs(dx[y, x])))
        if turn < 22.5:
            ok = m > size.get((y, x - 1), 0) and m >= size.get((y, x + 1), 0)
        elif turn > 67.5:
            ok = m > size.get((y - 1, x), 0) and m >= size.get((y + 1, x), 0)
        else:
            s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
            ok = m > size.get((y - 1, x - s), 0) and m > size.get((y + 1, x + s), 0)
        if ok and m > weak:
            crest.add((y, x))
    found = {p for p in crest if size[p] > strong}
    open_ = list(found)
    while open_:
        y, x = open_.pop()
        for p in ((y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)):
            if p in crest and p not in found:
                found.add(p)
                open_.append(p)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_edges(seed):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 256, (23, 31)) if seed < 2 else np.clip(np.add.outer(rng.normal(size=40).cumsum() * 25, rng.normal(size=33).cumsum() * 25) + 128, 0, 255).astype(int)
    assert {tuple(p) for p in np.argwhere(images.edges(g)).tolist()} == plain_edges(g, 80, 160)
    assert {tuple(p) for p in np.argwhere(images.edges(g, 10, 300)).tolist()} == plain_edges(g, 10, 300)


def test_edge_density_of_a_square(spark):
    page = np.zeros((40, 50, 3), np.uint8)
    page[10:30, 15:35] = 255
    flat = np.full((8, 8, 3), 211, np.uint8)
    df = spark.createDataFrame([(1, 40, 50, 3, bytearray(page.tobytes())), (2, 8, 8, 3, bytearray(flat.tobytes())), (3, 1, 1, 3, bytearray(3))], "id long, height int, width int, channels int, data binary")
    got = {r["id"]: (r["bright_ratio"], r["edge_density"]) for r in images.layout_signals(df).collect()}
    outline = len(plain_edges(page[:, :, 0], 80, 160))
    assert 70 <= outline <= 84  # one pixel wide around the square
    assert got == {1: (400 / 2_000, outline / 2_000), 2: (1.0, 0.0), 3: (0.0, 0.0)}


def test_wide_images_shrink_by_area():
    g = np.arange(4 * 2_800, dtype=float).reshape(4, 2_800) % 251
    assert np.array_equal(images._shrunk(g), np.floor(g.reshape(2, 2, 1_400, 2).mean((1, 3)) + 0.5))
    odd = np.random.default_rng(1).integers(0, 256, (7, 2_000)).astype(float)
    small = images._shrunk(odd)
    assert small.shape == (4, 1_400) and abs(small.mean() - odd.mean()) < 1 and images._shrunk(odd[:, :1_400]) is not None


def flood(cells, diagonal):
    """Number of components."""
    left, n = set(cells), 0
    while left:
        open_, n = [left.pop()], n + 1
        while open_:
            y, x = open_.pop()
            for p in ((y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if diagonal or not (i and j)):
                if p in left:
                    left.discard(p)
                    open_.append(p)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_components(seed):
    mask = np.random.default_rng(seed).random((17, 23)) < (0.3, 0.5, 0.6, 0.8)[seed]
    for diagonal in (True, False):
        assert images._components(mask, diagonal).max() == flood(map(tuple, np.argwhere(mask).tolist()), diagonal)


def test_image_differences(spark):
    rng = np.random.default_rng(5)
    pages = [np.kron(rng.integers(0, 2, (12, 12)) * 255, np.ones((8, 8), int)).astype(np.uint8), np.zeros((96, 96), np.uint8), np.pad(np.full((40, 40), 200, np.uint8), 28)]
    df = spark.createDataFrame([(i, 96, 96, 1, bytearray(p.tobytes())) for i, p in enumerate(pages)] + [(9, 96, 96, 1, None)], "id long, height int, width int, channels int, data binary")
    facts = []
    for p in pages:
        e = plain_edges(p, 60, 160)
        padded = {(y, x) for y in range(-1, 97) for x in range(-1, 97)} - e
        quarters = [sum(y // 48 == a and x // 48 == b for y, x in e) / 48**2 for a in (0, 1) for b in (0, 1)]
        facts.append((len(e) / 96**2, quarters, flood(e, True) + flood(padded, False) - 1))
    got = {r["id"]: (r["edge_density"], r["quadrants"], r["contours"]) for r in images.shape_features(df).collect()}
    assert {i: got[i] for i in range(3)} == dict(enumerate(facts)) and got[9] == (None, None, None) and facts[2][2] == 2
    pairs = spark.createDataFrame([(a, b, 10 * a + b) for a in (0, 1, 2, 9) for b in (0, 1, 2, 7)], "crop long, image long, query long")
    for r in images.image_differences(pairs, images.shape_features(df)).collect():
        a, b = facts[r["crop"]], facts[r["image"]]
        want = (abs(a[0] - b[0]) + sum(abs(x - y) for x, y in zip(a[1], b[1])) / 4 + abs(a[2] - b[2]) / 9216 * 250) / 3
        assert abs(r["difference"] - want) < 1e-12 and r["query"] == 10 * r["crop"] + r["image"]
    assert images.image_differences(pairs, images.shape_features(df)).count() == 9

"""The expected number carried through a manual that is cut anywhere."""

import random

import pytest

from stepweave.operators import sequences


@pytest.mark.parametrize("pages", [1, 7, 1_000])
def test_any_cut_gives_the_same(spark, pages):
    rng = random.Random(3)
    rows = [(s, rng.randint(1, 90), rng.choice((1, 2, 3, 4, 5, 6, 7, None)) if s % 2 else k // 3 + 1) for s in range(6) for k in range(60)]
    df = spark.createDataFrame(rows, "set_id long, page int, bag int")
    whole = sequences.consecutive_accept(df, first=2)
    cut = sequences.consecutive_accept(df, first=2, pages=pages)
    assert cut.columns == whole.columns and sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    expected, got = {}, {}
    for s, page, bag in sorted(r for r in rows if r[2]):
        if bag == expected.setdefault(s, 2):
            expected[s] += 1
            got.setdefault(s, []).append((page, bag))
    assert {s: sorted((r["page"], r["bag"]) for r in cut.filter(f"accepted AND set_id = {s}").collect()) for s in got} == got
    assert sequences.consecutive_accept(df.limit(0), pages=pages).count() == 0

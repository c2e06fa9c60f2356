"""Keyed streams on shuffled and late input against their batch meaning, and what their state holds."""

import random
import time

from pyspark.sql import Row, functions as F

from stepweave.operators import sequences, state
from stepweave.streaming import incremental, keyed


def fed(spark, tmp_path, parts, make, name="out", **trigger):
    """``parts`` sent one after another through one query; the rows that came out."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = make(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")))
        query = made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(**(trigger or {"availableNow": True})).start()
        assert query.awaitTermination(60) and query.exception() is None
    return spark.read.schema(made.schema).parquet(str(tmp_path / name))


def kept(spark, tmp_path, variable, name="out"):
    """The entries of a state variable after the last batch."""
    return spark.read.format("statestore").option("path", str(tmp_path / f"{name}_c")).option("stateVarName", variable).load()


def test_resets_of_shuffled_rows_are_w03(spark, tmp_path):
    rng = random.Random(4)
    steps = [(s, page, rng.choice((1, 1, rng.randint(2, 60), 900)), page * 60 + k) for s in (1, 2) for page in range(1, 41) for k in range(rng.randint(1, 3))]
    frame = lambda r: spark.createDataFrame(r, "set_id long, page int, value int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    # rows of twenty minutes come in any order within their part, and a few come one part later
    parts = [[] for _ in range(3)]
    for r in steps:
        parts[min(r[3] // 1_200 + (rng.random() < 0.2), 2)].append(r)
    for p in parts:
        rng.shuffle(p)
    got = fed(spark, tmp_path, [*(frame(p) for p in parts if p), frame([(0, 1, 1, 100_000)])], lambda rows: incremental.reset_stream(rows, "25 minutes"))
    got = sorted((r["set_id"], r["page"], r["low"], r["high"], r["previous"], r["bag_start"]) for r in got.filter("set_id > 0").collect())
    want = []
    for s in (1, 2):
        previous = None
        for page in sorted({p for i, p, _, _ in steps if i == s}):
            v = [x for i, p, x, _ in steps if (i, p) == (s, page)]
            want.append((s, page, min(v), max(v), previous, max(v) <= 200 and min(v) == 1 and previous is not None and previous >= 11))
            previous = max(v) if max(v) <= 200 else previous
    assert got == want
    left = kept(spark, tmp_path, "waiting").collect()
    assert {r["key"]["set_id"] for r in left} <= {0} and kept(spark, tmp_path, "done").count() <= 3  # nothing waits but what the watermark hasn't passed


def test_late_pages_change_nothing(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(r, "set_id long, page int, value int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    parts = [frame((1, 1, 12, 60), (1, 5, 20, 300), (0, 1, 1, 10_000)), frame((1, 3, 1, 9_900), (1, 6, 1, 9_950), (0, 3, 1, 90_000))]
    got = fed(spark, tmp_path, parts, incremental.reset_stream).filter("set_id = 1").collect()
    assert sorted((r["page"], r["previous"], r["bag_start"], r["late"]) for r in got) == [(1, None, False, False), (3, 20, False, True), (5, 12, False, False), (6, 20, True, False)]


def test_scan_in_chunks_is_w18_and_holds_two_numbers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, page, rng.randint(1, 6)) for s in range(1, 5) for page in sorted(rng.sample(range(1, 200), 40))]
    chunks = [spark.createDataFrame(rng.sample(c, len(c)), "set_id long, page int, bag int") for lo in (0, 100) if (c := [r for r in rows if lo <= r[1] < lo + 100])]
    got = fed(spark, tmp_path, chunks, incremental.incremental_scan)
    whole = sequences.consecutive_accept(spark.createDataFrame(rows, "set_id long, page int, bag int"))
    assert sorted(map(tuple, got.select("set_id", "page", "bag", "accepted", "reason").collect())) == sorted((r["set_id"], r["page"], r["bag"], r["accepted"], r["reason"]) for r in whole.collect())
    held = {r["key"]["set_id"]: tuple(r["value"]) for r in kept(spark, tmp_path, "at").collect()}
    assert held == {s: (1 + sum(r["accepted"] for r in got.filter(f"set_id = {s}").collect()), 1 + max(p for i, p, _ in rows if i == s)) for s in range(1, 5)}


def test_scan_forgets_after_a_time(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "set_id long, page int, bag int")
    make = lambda stream: incremental.incremental_scan(stream, forget_after=1_000)
    fed(spark, tmp_path, [rows((1, 5, 1), (1, 6, 2))], make, once=True)
    time.sleep(2)
    got = fed(spark, tmp_path, [rows((1, 2, 1))], make, once=True)
    assert sorted((r["page"], r["expected"], r["accepted"]) for r in got.collect()) == [(2, 1, True), (5, 1, True), (6, 2, True)]


def test_truth_in_parts_is_m01(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, rng.randint(1, 4), rng.randint(1, 3), k) for k, s in enumerate([1, 2, 3] * 30)]
    kinds = "set_id long, bag int, page int, ordinal long"
    parts = [spark.createDataFrame(rng.sample(rows[lo : lo + 45], 45), kinds) for lo in (0, 45)]
    got = fed(spark, tmp_path, parts, incremental.truth_conflicts)
    empty = spark.createDataFrame([], "set_id long, bag int, page int")
    want = state.truth_upsert(empty, spark.createDataFrame(rows, kinds))[0]
    columns = ["set_id", "bag", "page", "ordinal", "status", "existing_page"]
    key = lambda r: r[3]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(map(tuple, want.select(columns).collect()), key=key)
    assert kept(spark, tmp_path, "held").count() == len({r[:2] for r in rows})


class Calls:
    """A state of one key that counts the calls to it."""

    def __init__(self):
        self.n, self.maps, self.values, self.lists, self.timers = 0, {}, {}, {}, set()

    def __getattr__(self, name):
        def call(*given):
            self.n += 1
            return getattr(Calls, f"_{name}")(self, *given)

        return call

    def getMapState(self, *_):
        return self

    getValueState = getListState = getMapState
    _getValue = lambda self, key: self.maps.get(key)
    _updateValue = lambda self, key, value: self.maps.update({key: value})
    _removeKey = lambda self, key: self.maps.pop(key)
    _iterator = lambda self: list(self.maps.items())
    _update = lambda self, value: self.values.update(all=value)
    _registerTimer = lambda self, at: self.timers.add(at)
    _deleteTimer = lambda self, at: self.timers.discard(at)
    _appendList = lambda self, rows: self.lists.setdefault("all", []).extend(rows)

    def _get(self):
        return list(self.lists.get("all", [])) if self.lists or not self.values else self.values["all"]


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_resets_call_the_store_by_blocks(spark):
    state, pages = Calls(), [Row(set_id=1, page=p, value=(p * 7) % 60 + 1, ts=None, at=p * 1_000) for p in range(1, 1_001)]
    resets = keyed.Resets(10, 200)
    resets.init(state)
    for half in (pages[:500][::-1], pages[500:]):
        assert list(resets.handleInputRows((1,), iter(half), None)) == []
    assert state.n <= 30 and state.timers == {1_001}
    out = list(resets.handleExpiredTimer((1,), At(700_000), None))
    assert [r["page"] for r in out] == list(range(1, 700)) and 700_001 in state.timers and state.n <= 50
    assert {p for entry in state.maps.values() for p in entry[0]} == set(range(700, 1_001))
    assert [r["page"] for r in resets.handleExpiredTimer((1,), At(2_000_000), None)] == list(range(700, 1_001)) and not state.maps


def test_truth_calls_the_store_once_for_many_bags(spark):
    state, truth = Calls(), keyed.Truth()
    truth.init(state)
    rows = [Row(set_id=1, bag=b, page=b + k, ordinal=k * 100 + b, block=0) for k in range(3) for b in range(64)]
    out = list(truth.handleInputRows((1, 0), iter(rows[::-1]), None))
    assert [r["status"] for r in out] == ["inserted"] * 64 + ["conflict"] * 128 and out[-1]["existing_page"] == 63
    assert state.n == 2 and len(state.lists["all"]) == 64
    assert [r["status"] for r in truth.handleInputRows((1, 0), iter(rows[:64]), None)] == ["exists"] * 64 and state.n == 3

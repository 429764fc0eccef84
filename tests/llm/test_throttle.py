"""Token-bucket throttling against a plain walk, its packed state, restarts and odd input."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import throttle
from trellis.llm.common import Workspace

C, T0 = throttle.COST, datetime.datetime(2024, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, bucket string"


def plain(rows, batches=10):
    """The contract, click by click."""
    rows = {r for r in rows if r[1] is not None and r[3] is not None}
    us = lambda t: (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    hours = [us(r[2]) // 3_600_000_000 for r in rows if r[2]]
    lo, hi = min(hours, default=0), max(hours, default=0)
    at = [[] for _ in range(batches)]
    for click, ts, arrived, client, _ in rows:
        b = (us(arrived) // 3_600_000_000 - lo) * batches // (hi - lo + 1) if arrived else batches - 1
        late = click is not None and zlib.crc32(str(click).encode()) % 7 == 0
        at[min(batches - 1, b + late)].append((us(ts), click is not None, click or 0, client))
    out, waiting, seen, accounts = [], [], [], {}

    def settle(some, batch):
        for ts, named, click, client in sorted(some):
            credit, last, since = accounts.get(client, (12 * C, ts, None))
            credit = min(12 * C, credit + ts - last)
            if credit >= C:
                accounts[client] = credit - C, ts, None
                out.append((click if named else None, "admitted", batch, credit - C, None, None))
            else:
                since = ts if since is None else since
                accounts[client] = credit, ts, since
                out.append((click if named else None, "throttled", batch, credit, since, ts + C - credit))

    for b, own in enumerate(at):
        w = max(seen) - throttle.GRACE if seen else -(2**63)
        settle([x for x in waiting if x[0] < w], b)
        out += [(x[2] if x[1] else None, "late", b, None, None, None) for x in own if x[0] < w]
        waiting = [x for x in waiting if x[0] >= w] + [x for x in own if x[0] >= w]
        seen += [x[0] for x in own]
    settle(waiting, batches - 1)
    return sorted(out, key=str)


def some_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        client = int(rng.choice([1, 1, 1, 2, 3, 40, 41]))
        ts = T0 + datetime.timedelta(seconds=int(rng.choice([0, 7, 11, 26, 39])) * 3600 + int(rng.integers(0, 900)), microseconds=int(rng.integers(0, 3)))
        late = datetime.timedelta(seconds=int(rng.choice([1, 5, 9 * 3600, 20 * 3600])))
        rows.append((i // 2 * 2, ts, ts + late, client, f"x{i % 3}"))
    return rows + rows[:30] + [(None, T0, T0, 1, "a"), (7, None, T0, 1, "a"), (8, T0, T0, None, "a"), (9, T0, None, 2, None), (-5, datetime.datetime(1969, 12, 31, 23), T0, 3, "a")]


def test_like_a_plain_walk_with_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(throttle, "CLICKS_A_BUCKET", 60)
    rows = some_rows(3)
    got = throttle.throttle(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert {r["outcome"] for r in got} == {"admitted", "throttled", "late"}


def test_empty_table(spark):
    assert throttle.throttle(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_a_batch_fed_again_adds_nothing(spark):
    """Feeding goes on from the checkpoint: a batch that was taken is not taken twice, a break between batches loses nothing."""
    rows = some_rows(5, 120)
    root = Workspace(spark, "throttle").root
    throttle.deal(spark.createDataFrame(rows, SCHEMA), 2).write.partitionBy("batch").parquet(f"{root}/written")
    top = spark.read.parquet(f"{root}/written").where("batch = 0").agg(F.max("ts")).first()[0]
    for batch, horizon in ((0, -(2**63)), (1, top - throttle.GRACE)):
        spark.range(2).select(F.col("id").cast("int").alias("bucket"), F.lit(horizon).alias("ts")).write.mode("append").parquet(f"{root}/written/batch={batch}")
        throttle.feed(spark, root, 2, batch, 2)
        throttle.feed(spark, root, 2, batch, 2)
    got = spark.read.schema(throttle._OUT).parquet(f"{root}/out").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 2)


def test_packed_state_round_trip():
    rng = np.random.default_rng(1)
    waiting = {"ts": np.sort(rng.integers(-(2**60), 2**60, 50)), "click": rng.integers(-9, 9, 50), "client": rng.integers(0, 2**62, 50), "named": rng.random(50) < 0.5}
    credits = {n: rng.integers(-(2**62), 2**62, 7) for n, _ in throttle._CREDITS}
    a, b = throttle.unpack(throttle.pack(waiting, credits))
    assert all(np.array_equal(a[n], waiting[n]) for n in waiting) and all(np.array_equal(b[n], credits[n]) for n in credits)
    empty = throttle.unpack(throttle.pack(*throttle.unpack(None)))
    assert all(len(c) == 0 for t in empty for c in t.values())


def test_ends_of_penalties_and_full_credit():
    ts = [0] * 13 + [C - 1, C, C + 1, 20 * C]
    clicks = {"ts": np.array(ts), "click": np.arange(len(ts)), "client": np.zeros(len(ts), np.int64), "named": np.ones(len(ts), bool)}
    order, admitted, after, starts, ends = throttle.settle(clicks, {})
    assert order.tolist() == list(range(len(ts)))
    assert admitted == [True] * 12 + [False, False, True, False, True]
    assert starts[12:16] == [0, 0, None, C + 1] and ends[12:16] == [C, C, None, 2 * C]
    assert after[11:] == [0, 0, C - 1, 0, 1, 11 * C]


def test_a_bucket_needs_its_tick():
    class State:
        exists = False

    frame = throttle.pd.DataFrame({"tick": [False], "ts": [1], "click": [1], "client": [1], "named": [True], "batch": [0]})
    with pytest.raises(ValueError, match="no tick"):
        list(throttle.bucket_step((0,), iter([frame]), State()))

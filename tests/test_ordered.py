"""Ordered passes against a loop, with a target that fills many ranges."""

import random

import numpy as np

from tenderflow.operators.ordered import ALWAYS, NEVER, Growth, replacing_rows


def loop(rows, more, now):
    state, out = {}, []
    for i, target, own_size, own_at, size, at in sorted(rows):
        s, t = state.get(target, (size, at))
        if own_size > s + more or own_at > t:
            out.append(i)
            s, t = own_size, now
        state[target] = (s, t)
    return out


def test_growth():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(12)
        size = np.array([rnd.randrange(0, 300, 10) for _ in range(n)], np.int64)
        at = np.array([rnd.choice([NEVER, 5, 15, 25, 40]) for _ in range(n)], np.int64)
        g = Growth(size, at, 50, 30)
        for first in [(0, 0), (100, 20), (300, ALWAYS), (50, 10)]:
            rows = [(i, "t", int(size[i]), int(at[i]), *first) for i in range(n)]
            kept, end, _ = g.replaced(*first)
            assert kept.tolist() == loop(rows, 50, 30)
            hit = next((r for s, t, r in g.outcome() if s > first[0] or t > first[1]), first[0])
            assert hit == end


def test_replacing_rows_over_many_ranges(spark):
    rnd = random.Random(2)
    rows, begin = [], {}
    for i in range(6000):
        target = "hot" if i % 3 else f"t{rnd.randrange(900)}"
        begin.setdefault(target, (rnd.randrange(400), rnd.choice([ALWAYS, 100, 2000])))
        size = i // 3 if target == "hot" and i < 5000 else rnd.randrange(1000)
        rows.append((i, target, size, rnd.choice([NEVER, NEVER, 50, 1500, 3000 if i % 900 == 0 else 10]), *begin[target]))
    df = spark.createDataFrame(rows, "id long, target string, own_size long, own_at long, size long, at long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted(r["id"] for r in replacing_rows(df, 50, 2500).collect())
            assert got == loop(rows, 50, 2500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert replacing_rows(df.limit(0), 50, 2500).collect() == []


def test_a_chain_of_any_length(spark):
    """Every row replaces the one before it."""
    df = spark.range(20_000).selectExpr("id", "'t' AS target", "id * 51 + 51 AS own_size", f"{NEVER} AS own_at", "0L AS size", f"{ALWAYS} AS at")
    assert replacing_rows(df, 50, 0).count() == 20_000

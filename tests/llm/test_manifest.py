"""The Merkle manifest against a row-by-row one, and its records and proofs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderflow.llm import merkle_manifest
from tenderflow.llm.common import segment_sums

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, tree string, path string, rank string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def runs(digests):
    """The root of some digests, and each one's siblings as (left, right) per level."""
    paths, place, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(place):
            a = p - p % 16
            paths[i].append(("".join(level[a:p]), "".join(level[p + 1 : a + 16])))
            place[i] = p // 16
        level = [h(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: runs([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, above = runs([tops[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for x, path in zip(sorted(by[s], key=lambda x: x[:3]), tops[s][1], strict=True):
            r = x[3]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf((*r[:4], lower(r[4]) if changed else r[4]))
            for left, right in path + up:
                fold = h(left, fold, right)
            out.append((r[0], x[2], tops[s][0], root, h(*[a + b for a, b in path + up]), fold, fold == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def check(spark, rows):
    got = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    return got


def clash(rows):
    return [(*r, "row", "tree", "path", "rank") for r in rows]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 - 5, rng.choice(["a", "a", "a", "Z", "é", None]), rng.choice(["en", None]), i, rng.choice(["Big TEXT", "small", "", None, "Ä ß"])) for i in range(n)]
    got = check(spark, clash(rows))
    if n == 300:
        assert {r["verified"] for r in got} == {True, False}


def test_nulls_repeats_long_texts_and_many_sources(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "a", "en", 3, "ABC")]
    rows += [(5, "a", "en", 3, "ABC")] * 40 + [(5, "a", "en", 3, "abc")] * 3
    rows += [(9, "long", "en", 1, "Lorem Ipsum " * 200_000)]
    rows += [(i, f"source {i}", "en", 1, "X") for i in range(40)]
    check(spark, clash(rows))


def test_empty(spark):
    got = merkle_manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_some_requests(spark):
    """Requests for a few leaves only reach the nodes on their way."""
    n = 16**3 + 5
    leaves = spark.range(n).select(
        F.lit(0).cast("long").alias("tree"), F.col("id").alias("at"), merkle_manifest.height(F.lit(n)).alias("h"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest")
    )
    levels, tops = merkle_manifest.grow(leaves, "t")
    root, paths = runs([h(str(i)) for i in range(n)])
    assert [x.count() for x in levels] == [257, 17, 2, 1] and tops.first()["digest"] == root
    some = leaves.where("at IN (0, 77, 4100)")
    begins = tops.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    got = merkle_manifest.descend(some.select("tree", "at", "h"), levels, begins, [], "t").collect()
    assert {r["at"]: ([tuple(s) for s in r["path"]][::-1], r["digest"]) for r in got} == {i: (paths[i], h(str(i))) for i in (0, 77, 4100)}


def test_segment_sums_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b"]), i, rng.choice([1, 5, 2**62])) for i in range(3000)] + [("c", 1, 7)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    want, total = {}, {}
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        total[k] = (total.get(k, 0) + v + 2**63) % 2**64 - 2**63
        want[(k, o)] = total[k]
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {(r["k"], r["o"]): r["s"] for r in segment_sums(df, ["k"], ["o"], {"s": "v"}).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want

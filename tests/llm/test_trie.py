"""The prefix trie against one built turn by turn."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tenderflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth string, p string, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, order, role, text))
    for c in own:
        own[c] = [x[4:] for x in sorted(own[c])]
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)  # noqa: E731  the sign of the remainder is that of c
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(base(c), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if made[c] == k)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def check(spark, rows, **options):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **options)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def clash(rows):
    return [(*r, "conv", "depth", "p", "n") for r in rows]


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-150, 400), n):
        for t in range(rng.choice([1, 2, 3, 6, 8])):
            out.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "user", "bot", None]), rng.choice(["hi", "hi", "hi", "ho é", "", None])))
    return out


@pytest.mark.parametrize("cells", [prefix_trie.MOST_CELLS, 64])
def test_trie(spark, cells):
    """With few cells the sketch proves little, and the result is the same."""
    check(spark, clash(conversations(1, 200)), most_cells=cells)


def test_one_conversation_and_empty(spark):
    check(spark, clash([(3, 0, "user", "a"), (3, 1, None, None)]))
    check(spark, clash([(100, 0, "user", "a"), (100, 1, None, None)]))
    check(spark, clash([(None, 0, "user", "a")]))
    check(spark, [])


def test_copies_long_texts_repeated_rows_and_shared_heads(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 360) for t in range(4)]
    rows += [(300, 2, "user", "again")] * 3 + [(401, 0, "user", "x " * 300_000), (402, 0, "user", "x " * 300_000)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(100, 130) for t in range(9)]
    rows += [(7, t, "user", "echo") for t in range(700)] + [(8, t, "user", "echo") for t in range(600)]
    check(spark, clash(rows))


def test_hot_node_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(5000).select(F.lit(1).cast("long").alias("p"), F.lit(2).cast("long").alias("q"), F.lit(3).cast("long").alias("depth"), F.col("id").alias("conv"))
    got = prefix_trie.member_digests(ends).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]


def test_tails_do_not_shuffle(spark):
    """Prefixes of one conversation only are proven so, but for a few."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(100, 200) for t in range(20)]
    prefixes = prefix_trie.segment_sums(prefix_trie.with_values(prefix_trie.rebuilt(spark.createDataFrame(clash(rows), SCHEMA))), ["conv"], ["depth"], {"p": "v", "q": "w"})
    got = prefix_trie.screened(prefix_trie.stored(prefixes))
    shared = {k: n for k, n in collections.Counter((r["p"], r["q"], r["depth"]) for r in got.collect()).items()}
    proven = got.where("single").collect()
    assert all(shared[r["p"], r["q"], r["depth"]] == 1 for r in proven)
    assert len(proven) >= 0.95 * sum(n == 1 for n in shared.values())

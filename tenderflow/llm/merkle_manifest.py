"""Merkle manifest of a dataset, with proofs by descent in a content-addressed graph.

Leaves are digests of rows. The leaves of a source, in the order of their ids, are hashed in runs of 16, the runs' digests again, until
one digest is left; the sources' digests, in the order of the sources, are hashed the same way up to the root. Every inner node is
stored as a record from its digest to its children's digests.

A proof is found from the root downwards: requests for leaves, told by their rank in the tree, look up the record of the root's digest, take
the child that the rank's highest digit to base 16 names, and go on there, collecting the children that were not taken. Requests
travel as one as long as their digits agree, so a level has at most as many of them as the tree has nodes there, and no record is
asked for by more than the requests for its own place. At the leaf the segments of the path are reversed.

Digests are lower-case hexadecimal SHA-256 of the concatenated parts, inner digests as hexadecimal text.

Nulls: a null field enters a leaf as `-`. A null source is a source of its own, before the others; null ids come first in a source, rows
with equal ids follow their digests, equal rows are leaves of their own. A row without an id is never changed by `tampered`. A lone
leaf is its source's digest, and a lone source's digest is the root; a proof without siblings is the digest of an empty text. Only the
five named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import running_total, segment_sums, stored, table, with_lookup

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run has 1 << BITS nodes.
BITS = 4
#: Levels that a tree of 63-bit ranks can have.
MOST_LEVELS = 15


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def framed(c: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(F.concat(*[framed(c) for c in columns]))


def height(n: Column) -> Column:
    """Levels above n leaves: the least h for which runs of 16, h times over, leave one node."""
    out = F.lit(0)
    for k in range(MOST_LEVELS + 1):
        out = out + (n > F.lit(1 << (BITS * k))).cast("int")
    return out


def grow(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes above leaves (tree, at, h, digest), and the top (tree, h, digest) of each tree.

    Level k holds (tree, at, h, digest, children) of the trees of height k and more.
    """
    highest = leaves.agg(F.max("h")).first()[0] or 0
    tops, levels, below = leaves.where("h = 0").select("tree", "h", "digest"), [], leaves
    for k in range(1, highest + 1):
        runs = below.where(F.col("h") >= k).groupBy("tree", F.shiftright("at", BITS).alias("at")).agg(
            F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run")  # 16 at most
        )
        children = F.transform("run", lambda c: c["digest"])
        below = stored(runs.select("tree", "at", "h", digest(F.array_join(children, "")).alias("digest"), children.alias("children")), f"{name}-{k}")
        levels.append(below)
        tops = tops.union(below.where(F.col("h") == k).select("tree", "h", "digest"))
    return levels, stored(tops, f"{name}-tops")


def records(level: DataFrame) -> DataFrame:
    """Digest to children. Equal subtrees have one record."""
    return level.select(F.col("digest").alias("_digest"), "children").dropDuplicates(["_digest"])


def opened(asked: DataFrame, level: DataFrame) -> DataFrame:
    """The children of the nodes that the requests (tree, at, digest, path) have come to."""
    return asked.join(records(level), F.col("digest") == F.col("_digest")).select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "path", "children")


def stepped(requests: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Requests (tree, at, ...) for children: each takes the child of its last digit and collects the others."""
    found = requests.join(nodes, (F.col("tree") == F.col("_tree")) & (F.shiftright("at", BITS) == F.col("_at")))
    digit = F.col("at").bitwiseAND((1 << BITS) - 1).cast("int")
    left = F.array_join(F.slice("children", F.lit(1), digit), "")
    right = F.array_join(F.slice("children", digit + 2, F.greatest(F.size("children") - digit - 1, F.lit(0))), "")
    return found.select(
        "tree", "at", *keep, F.element_at("children", digit + 1).alias("digest"),
        F.array_append("path", F.struct(left.alias("left"), right.alias("right"))).alias("path"),
    )


def descend(requests: DataFrame, levels: list[DataFrame], tops: DataFrame, keep: list[str], name: str) -> DataFrame:
    """(tree, at, *keep, digest, path) of the requested leaves; path runs from the top downwards.

    `requests(tree, at, h, *keep)`; `tops(tree, h, digest, path)` are where each tree's requests begin.
    """
    wanted = [requests]
    for k in range(1, len(levels) + 1):
        wanted.append(stored(wanted[-1].where(F.col("h") >= k).select("tree", F.shiftright("at", BITS).alias("at"), "h").distinct(), f"{name}-wanted"))
    begins = tops.withColumn("at", F.lit(0).cast("long"))
    asked = None
    for k in range(len(levels), 0, -1):
        here = begins.where(F.col("h") == k).select("tree", "at", "digest", "path")
        nodes = opened(here if asked is None else asked.unionByName(here), levels[k - 1])
        below = wanted[k - 1].where(F.col("h") >= k)
        if k == 1:
            asked = stepped(below, nodes, keep)
        else:
            asked = stored(stepped(below, nodes, []), f"{name}-asked")
    alone = requests.where("h = 0").join(begins.select(F.col("tree").alias("_tree"), "digest", "path"), F.col("tree") == F.col("_tree"))
    alone = alone.select("tree", "at", *keep, "digest", "path")
    return alone if asked is None else asked.unionByName(alone)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, segments from the leaf upwards."""
    return F.aggregate(path, leaf, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def tampered(doc_id: Column, text: Column) -> Column:
    """Lower-case text of the rows whose id has a checksum that 5 divides, else null: no other leaf is changed."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, changed, rank): rank from 0 in the source; `changed` is the leaf of the changed text, null where none is."""
    own = [F.col(f) for f in fields]
    doc_id, source, text = own[0], own[1], own[4]
    changed = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), leaf_digest(own).alias("leaf"),
        F.when(changed, leaf_digest([*own[:4], tampered(doc_id, text)])).alias("changed"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"),
    )
    ranked = segment_sums(rows, ["source"], ["doc_id", "leaf", "row"], {"place": "one"}, "leaves")
    return ranked.select("doc_id", "source", "leaf", "changed", (F.col("place") - 1).alias("rank"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of the table."""
    rows = stored(leaves(docs), "ranked")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    trees = stored(running_total(sizes, ["source"], "one", "tree", "sources").select("source", "tree", height(F.col("n")).alias("h")), "trees")
    n_trees = trees.count()
    rows = with_lookup(rows, trees, ["source"]).withColumnRenamed("rank", "at").drop("source")
    levels, tops = grow(rows.select("tree", "at", "h", F.col("leaf").alias("digest")), "nodes")

    # The sources' digests are the leaves of one more tree.
    top_leaves = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), height(F.lit(n_trees)).alias("h"), "digest")
    top_levels, top = grow(top_leaves, "sources")
    root = top.first()
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    begins = top.withColumn("path", no_path)
    sources = descend(top_leaves.select("tree", "at", "h"), top_levels, begins, [], "source-paths")
    sources = stored(sources.select(F.col("at").alias("_source"), "digest", "path"), "source-paths")
    begins = tops.join(sources.select("_source", "path"), F.col("tree") == F.col("_source")).select("tree", "h", "digest", "path")

    found = descend(rows, levels, stored(begins, "begins"), ["doc_id", "leaf", "changed"], "paths")
    upwards = found.withColumn("path", F.reverse("path"))
    subroots = stored(tops.select("tree", F.col("digest").alias("subroot")), "subroots")
    top_digest = F.lit(root["digest"] if root else None).cast("string")
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = upwards.select("tree", "doc_id", "leaf", top_digest.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return with_lookup(out, subroots, ["tree"]).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))

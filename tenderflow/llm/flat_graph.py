"""Near-duplicate vectors by a flat graph with pruned edges, built on overlapping cluster shards.

Only vectors of one label (and one length) are compared. Equal vectors become one node first, with its number of copies. A bounded
sample gives the centroids of each label's clusters; every node goes to the shards of its nearest clusters, so shards overlap. In a
shard each node gets the edges that robust pruning leaves of its nearest nodes: a candidate goes when one already taken is
nearer to it, by a factor, than the node is. The shards' adjacency lists, with their reverse edges, are united per node to one flat graph.

Every node is then a query. Clusters near each other form a block, which one task holds, with the nodes of other blocks that have one of its clusters among
their nearest. A greedy search with a beam starts at the shards' medoids (and at the query's own node) and goes on by expanding every
node within a wider range, until no new one is found, so it ends with the whole neighbourhood however large that is. What it finds
is kept by the exact cosine in double precision. Links stay in the task: it returns per query the number of linked vectors and per node the
root of what is linked there, from which the components follow.

Recall is audited: a bounded sample of nodes is compared with all nodes of its label; below `LEAST_RECALL` the graph is built again with
more overlap, more edges and a wider beam, and the job fails if that does not help.

A block of more than PART nodes, as a large group of near copies makes it, is cut into parts with graphs of their own. Each query then
searches all parts; parts have no nodes in common, so the numbers add up.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing, but have their row. Repeated
ids are rows of their own, with equal results if the vectors are equal. A null id stays; a component of null ids alone is null, and `kept` is
true in it. Only id, vector and label are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.llm.common import components, stored, table, uniform, with_lookup

THRESHOLD, LEAST_RECALL = 0.98, 0.9
#: Nodes and bytes of the sample that the centroids come from, and centroids at most.
SAMPLE, SAMPLE_BYTES, MOST_CENTROIDS = 20_000, 64 << 20, 8192
#: Nodes that compare with all others in the audit.
AUDITED = 200


@dataclass(frozen=True)
class Plan:
    shard: int = 1500  # nodes aimed at in a cluster
    overlap: int = 2  # shards of a node
    reach: int = 6  # nearest clusters whose blocks hold a node
    candidates: int = 48
    degree: int = 24  # edges out of a node, in a shard
    alpha: float = 1.2
    beam: int = 10
    block: int = 8000  # nodes aimed at in a block
    part: int = 12_000  # nodes of a block in one task


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---------------------------------------------------------------- nodes

def vector_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(row, vec_id, grp, k1, k2, v): grp is null where a vector cannot link; k1 and k2 tell equal vectors."""
    e = F.col(embedding)
    single = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    v = e if single else F.transform(e, lambda x: x.cast("double"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0) & F.col(label).isNotNull()
    grp = F.when(usable, F.concat(F.col(label).cast("string"), F.lit("/"), F.size(e).cast("string")))
    df = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), grp.alias("grp"), v.alias("v"))
    key = lambda seed: F.when(F.col("grp").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return df.withColumns({"k1": key(1), "k2": key(2), "v": F.when(F.col("grp").isNotNull(), F.col("v"))})


# ---------------------------------------------------------------- clusters

def means(x: np.ndarray, k: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """Unit means of k clusters of unit vectors; a cluster that gets empty is left out."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        length = np.sqrt((sums * sums).sum(1))
        c = sums[length > 1e-9] / length[length > 1e-9, None]
    return c


@dataclass
class Clusters:
    centroids: dict[str, np.ndarray]
    block: dict[str, np.ndarray]  # block of each cluster

    def near(self, grp: str, u: np.ndarray, k: int) -> np.ndarray:
        c = self.centroids.get(grp)
        if c is None:
            return np.zeros((len(u), 1), np.int64)
        return np.argsort(-(u @ c.T), axis=1, kind="stable")[:, :k]

    def blocks(self, grp: str, clusters: np.ndarray) -> np.ndarray:
        return self.block[grp][clusters] if grp in self.block else np.zeros_like(clusters)


def fitted(nodes: DataFrame, plan: Plan) -> Clusters:
    """Centroids of the labels that have more nodes than a shard, from a bounded sample."""
    sizes = stored(nodes.groupBy("grp").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("dim")), "sizes")
    large = stored(sizes.where(F.col("n") > plan.shard), "large")
    facts = large.agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), F.max("n").alias("most")).first()
    out = Clusters({}, {})
    if not facts["n"]:
        return out
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * facts["dim"])))
    # Labels too small to have a cluster in the sample are not worth one either.
    least = max(plan.shard, facts["n"] // MOST_CENTROIDS)
    picked = nodes.where(uniform(F.lit("centroids"), F.col("node")) < F.lit(rows / facts["n"])).join(large.where(F.col("n") > least).select(F.col("grp").alias("_g"), "n"), F.col("grp") == F.col("_g"))
    sample = picked.select("grp", "n", "v").limit(2 * rows).toPandas()
    for grp, own in sample.groupby("grp"):
        n = int(own["n"].iloc[0])
        k = min(-(-n // plan.shard), MOST_CENTROIDS * n // facts["n"] + 1, len(own) // 4)
        if k < 2:
            continue
        x = unit(np.stack(own["v"].to_list()))
        c = out.centroids[grp] = means(x, k)
        blocks = -(-n // plan.block)
        out.block[grp] = (c @ means(c, blocks).T).argmax(1) if blocks > 1 and n > plan.part else np.zeros(len(c), np.int64)
    return out


def placed(nodes: DataFrame, clusters: Clusters, plan: Plan) -> DataFrame:
    """(grp, node, copies, v, shards, blocks): the nearest clusters of a node, nearest first, and the distinct blocks it lies in, its own first."""
    shared = nodes.sparkSession.sparkContext.broadcast(clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards: list = [None] * len(batch)
            blocks: list = [None] * len(batch)
            grps = np.array(batch.column("grp").to_pylist(), object)
            for grp in set(grps):
                at = np.flatnonzero(grps == grp)
                near = shared.value.near(grp, unit(matrix(batch.column("v").take(pa.array(at)))), plan.reach)
                held = shared.value.blocks(grp, near)
                for i, c, b in zip(at, near, held, strict=True):
                    shards[i] = c[: plan.overlap]
                    blocks[i] = list(dict.fromkeys(b.tolist()))
            more = [pa.array(shards, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "shards", "blocks"])

    schema = T.StructType([*nodes.schema.fields, T.StructField("shards", T.ArrayType(T.IntegerType())), T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    return nodes.mapInArrow(run, schema)


# ---------------------------------------------------------------- graph

def nearest(u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) nearest others of each row by cosine, nearest first, and their cosines."""
    k = min(k, len(u) - 1)
    best, score = np.zeros((len(u), k), np.int64), np.zeros((len(u), k))
    for a in range(0, len(u), 512):
        s = u[a : a + 512] @ u.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, top, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        best[a : a + 512], score[a : a + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
    return best, score


def robust_prune(u: np.ndarray, best: np.ndarray, score: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(n, degree) neighbours, -1 where none: the nearest left is taken, and all go that are nearer to it, by alpha, than to the node."""
    n, k = best.shape
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 256):
        own, far = best[a : a + 256], np.sqrt(np.maximum(2 - 2 * score[a : a + 256], 0))
        x = u[own]
        between = np.sqrt(np.maximum(2 - 2 * (x @ x.transpose(0, 2, 1)), 0))
        alive, row = np.ones(own.shape, bool), np.arange(len(own))
        for j in range(min(degree, k)):
            first = alive.argmax(1)
            some = alive[row, first]
            out[a : a + 256, j] = np.where(some, own[row, first], -1)
            alive &= ~((alpha * between[row, first] <= far) & some[:, None])
            alive[row, first] = False
    return out


def shard_graph(pdf: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """Adjacency lists of a shard, both ways, and which node is its medoid."""
    ids, u = pdf["node"].to_numpy(), unit(np.stack(pdf["v"].to_list()))
    medoid = np.zeros(len(ids), bool)
    medoid[(u @ u.mean(0)).argmax()] = True
    if len(ids) == 1:
        return pd.DataFrame({"node": ids, "near": [np.zeros(0, np.int64)], "medoid": medoid})
    best, score = nearest(u, plan.candidates)
    edges = robust_prune(u, best, score, plan.degree, plan.alpha)
    a, j = np.nonzero(edges >= 0)
    b = edges[a, j]
    pairs = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
    a, b = pairs // len(ids), pairs % len(ids)
    lists = np.split(ids[b], np.searchsorted(a, np.arange(1, len(ids))))
    return pd.DataFrame({"node": ids, "near": lists, "medoid": medoid})


def flat_graph(spread: DataFrame, plan: Plan) -> DataFrame:
    """(node, near, medoid): the union of the adjacency lists of all shards a node is in."""
    shards = spread.select("grp", F.explode("shards").alias("shard"), "part", "node", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return shard_graph(pdf, plan)

    lists = shards.groupBy("grp", "shard", "part").applyInPandas(run, "node long, near array<long>, medoid boolean")
    # A list from each of a node's shards.
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))


# ---------------------------------------------------------------- search

class Roots:
    """Smallest member of what is linked, over links that come in lots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def scores(q: np.ndarray, u: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row))
    for a in range(0, len(row), 100_000):
        out[a : a + 100_000] = (q[row[a : a + 100_000]] * u[node[a : a + 100_000]]).sum(1)
    return out


@dataclass
class Lists:
    """Adjacency lists one after the other."""

    start: np.ndarray
    nodes: np.ndarray

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `some`, neighbour)."""
        size = self.start[some + 1] - self.start[some]
        row = np.repeat(np.arange(len(some)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return row, self.nodes[self.start[some][row] + within]


def in_range(u: np.ndarray, adjacent: Lists, entries: np.ndarray, q: np.ndarray, own: np.ndarray, wider: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of all nodes found from `wider` on, for some queries at a time.

    First a greedy search: the best node of the beam that is not open yet is opened, until all are. Then every node found within the
    wider range is opened, and so on with those that this finds.
    """
    n, m = len(u), len(q)
    seen, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
    at = np.broadcast_to(entries, (m, len(entries)))
    at = np.concatenate([at, own[:, None]], axis=1)  # -1 where a query is no node here
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fresh(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes not seen before, once each, with their cosines; those in the wider range are noted."""
        new = ~seen[row, node]
        key = np.unique(row[new] * n + node[new])
        row, node = key // n, key % n
        seen[row, node] = True
        s = scores(q, u, row, node)
        hit = s >= wider
        found.append((row[hit], node[hit], s[hit]))
        return row, node, s

    def best(row: np.ndarray, node: np.ndarray, s: np.ndarray) -> None:
        """Merge into the beams."""
        nonlocal ids, score, done
        order = np.lexsort((-s, row))
        row, node, s = row[order], node[order], s[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < beam
        new_ids, new_score = np.full((m, beam), -1), np.full((m, beam), -np.inf)
        new_ids[row[keep], place[keep]], new_score[row[keep], place[keep]] = node[keep], s[keep]
        all_ids, all_score = np.hstack([ids, new_ids]), np.hstack([score, new_score])
        all_done = np.hstack([done, np.zeros_like(done)])
        top = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids, score, done = (np.take_along_axis(x, top, 1) for x in (all_ids, all_score, all_done))

    ids, score, done = np.full((m, beam), -1), np.full((m, beam), -np.inf), np.zeros((m, beam), bool)
    row, j = np.nonzero(at >= 0)
    best(*fresh(row, at[row, j]))
    while True:
        closed = done | (ids < 0)
        row = np.flatnonzero(~closed.all(1))
        if not len(row):
            break
        place = closed[row].argmin(1)
        node = ids[row, place]
        done[row, place] = True
        opened[row, node] = True
        r, near = adjacent.of(node)
        best(*fresh(row[r], near))
    done_to = 0
    while done_to < len(found):
        row, node, _ = found[done_to]
        done_to += 1
        closed = opened[row, node]
        row, node = row[~closed], node[~closed]
        opened[row, node] = True
        for a in range(0, len(row), 20_000):
            r, near = adjacent.of(node[a : a + 20_000])
            fresh(row[a : a + 20_000][r], near)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def search_part(pdf: pd.DataFrame, plan: Plan, threshold: float) -> pd.DataFrame:
    """Per query of a part: the number of linked vectors; per node: the root of what is linked here."""
    out_of = {"node": np.zeros(0, np.int64), "n_linked": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
    nodes = pdf[pdf["is_node"]].sort_values("node")
    queries = pdf[pdf["is_query"]].sort_values("node")
    if not len(nodes) or not len(queries):
        return pd.DataFrame(out_of)
    ids, copies = nodes["node"].to_numpy(), nodes["copies"].to_numpy()
    u = unit(np.stack(nodes["v"].to_list()))
    lists = nodes["near"].to_list()
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
    to = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(owner) else np.zeros(0, np.int64)
    local = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    here = ids[local] == to
    owner, local = owner[here], local[here]
    adjacent = Lists(np.searchsorted(owner, np.arange(len(ids) + 1)), local)
    entries = np.flatnonzero(nodes["medoid"].to_numpy())
    if not len(entries):
        entries = np.array([0])
    # Within this range pruned edges always lead on to a neighbour: a step towards it is nearer by alpha.
    reach = np.sqrt(2 - 2 * threshold) * (1 + 1 / plan.alpha)
    wider = 1 - reach * reach / 2
    q_ids, q = queries["node"].to_numpy(), unit(np.stack(queries["v"].to_list()))
    own = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
    own = np.where(ids[own] == q_ids, own, -1)
    n_linked = np.zeros(len(q_ids), np.int64)
    # Queries that are no nodes here come behind the nodes, so that a root is the smallest id wherever a node has it.
    outside = np.flatnonzero(own < 0)
    number = own.copy()
    number[outside] = len(ids) + np.arange(len(outside))
    every = np.concatenate([ids, q_ids[outside]])
    roots = Roots(len(every))
    for a in range(0, len(q), 512):
        row, node, s = in_range(u, adjacent, entries, q[a : a + 512], own[a : a + 512], wider, plan.beam)
        kept = (s >= threshold) & (node != own[a + row])
        row, node = a + row[kept], node[kept]
        np.add.at(n_linked, row, copies[node])
        roots.link(number[row], node)
    of = every[roots.root]
    out = pd.DataFrame({"node": q_ids, "n_linked": n_linked, "root": of[number]})
    asked = np.zeros(len(every), bool)
    asked[number] = True
    rest = np.flatnonzero(~asked & (roots.root != np.arange(len(every))))
    return pd.concat([out, pd.DataFrame({"node": every[rest], "n_linked": np.zeros(len(rest), np.int64), "root": of[rest]})])


def searched(nodes: DataFrame, clusters: Clusters, plan: Plan, threshold: float) -> DataFrame:
    """(node, n_linked, root) from all parts: a node has a row for each part where it was asked or linked."""
    where = stored(placed(nodes, clusters, plan), "clusters")
    held = where.select("grp", F.posexplode("blocks").alias("order", "block"))
    blocks = held.groupBy("grp", "block").agg(F.count("*").alias("n"), F.sum((F.col("order") == 0).cast("long")).alias("asks"))
    sizes = stored(blocks.select("grp", "block", F.ceil(F.col("n") / plan.part).cast("int").alias("parts"), F.greatest(F.ceil(F.col("asks") / plan.part), F.lit(1)).cast("int").alias("slices")), "blocks")
    # A graph is cut as its node's own block is, so that its edges stay in one part of it.
    own = with_lookup(where.withColumn("block", F.get("blocks", F.lit(0))), sizes, ["grp", "block"])
    spread = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("block", "parts", "slices")
    spread = stored(spread, "spread")
    graph = stored(flat_graph(spread, plan), "graph")
    joined = spread.drop("part").join(graph.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    at = joined.select("grp", "node", "copies", "v", "near", "medoid", F.posexplode("blocks").alias("order", "block"))
    at = with_lookup(at, sizes, ["grp", "block"]).withColumns(
        {"p": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "s": F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"), "asks": F.col("order") == 0}
    )
    # As a node it is in its part, for all slices of queries; as a query in its slice, for all parts.
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(
        p.alias("part"), s.alias("slice"), (p == F.col("p")).alias("is_node"), ((s == F.col("s")) & F.col("asks")).alias("is_query")))))
    rows = at.withColumn("cell", F.explode(F.filter(cells, lambda c: c["is_node"] | c["is_query"]))).select(
        "grp", "block", "cell.part", "cell.slice", "node", "copies", "v", F.when(F.col("cell.is_node"), F.col("near")).alias("near"), "medoid", "cell.is_node", "cell.is_query"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return search_part(pdf, plan, threshold)

    return rows.groupBy("grp", "block", "part", "slice").applyInPandas(run, "node long, n_linked long, root long")


# ---------------------------------------------------------------- audit

def audit(nodes: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """Links found of all links, by comparing a bounded sample of nodes with all nodes. `counts(node, n_linked)`."""
    n = nodes.count()
    some = nodes.where(uniform(F.lit("audit"), F.col("node")) < F.lit(2.0 * audited / max(n, 1))).select("grp", "node", "v").orderBy("node").limit(audited)
    some = stored(some, "audited")
    asked = some.toPandas()
    groups = {g: (own["node"].to_numpy(), unit(np.stack(own["v"].to_list()))) for g, own in asked.groupby("grp")}
    shared = nodes.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grps = np.array(batch.column("grp").to_pylist(), object)
            for grp in set(grps) & set(shared.value):
                ids, u = shared.value[grp]
                at = pa.array(np.flatnonzero(grps == grp))
                own = batch.column("node").take(at).to_numpy()
                linked = (u @ unit(matrix(batch.column("v").take(at))).T >= threshold) & (ids[:, None] != own)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ batch.column("copies").take(at).to_numpy())], ["node", "n"])

    true = nodes.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(F.broadcast(some.select(F.col("node").alias("_node"))), F.col("node") == F.col("_node"))  # AUDITED rows at most
    row = both.join(counts, "node").agg(F.sum("n_linked").alias("found"), F.sum("n").alias("true")).first()
    return row["found"] / row["true"] if row["true"] else 1.0


# ---------------------------------------------------------------- result

def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, plan: Plan | None = None, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    plan = plan or Plan()
    rows = stored(vector_rows(vectors, vec_id, embedding, label), "rows")
    groups = rows.where("grp IS NOT NULL").groupBy("grp", "k1", "k2").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    groups = stored(groups, "groups")
    first = groups.select(F.col("node").alias("_node"), "copies")
    nodes = stored(rows.join(first, F.col("row") == F.col("_node")).select("grp", F.col("row").alias("node"), "copies", "v"), "nodes")
    for turn in range(3):
        found = stored(searched(nodes, fitted(nodes, plan), plan, threshold), "found")
        counts = stored(found.groupBy("node").agg(F.sum("n_linked").alias("n_linked")), "counts")
        recall = audit(nodes, counts, threshold)
        if recall >= LEAST_RECALL:
            break
        if turn == 2:
            raise RuntimeError(f"recall {recall:.3f} of the audit stays below {LEAST_RECALL}")
        plan = replace(plan, overlap=plan.overlap + 1, reach=2 * plan.reach, candidates=2 * plan.candidates, degree=2 * plan.degree, beam=2 * plan.beam)
    linked = stored(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")

    own: Column = F.col("grp").isNotNull()
    members = with_lookup(rows.select("row", "vec_id", "grp", "k1", "k2"), groups, ["grp", "k1", "k2"])
    members = stored(members.select("row", "vec_id", F.when(own, F.col("node")).alias("node"), "copies"), "members")
    of_node = members.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.first("copies").alias("copies"))
    facts = of_node.join(counts, "node").join(linked.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = stored(facts, "facts")
    least = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "component").select("node", "component_id", (F.col("n_linked") + F.col("copies") - 1).alias("n_links"))
    out = with_lookup(members.select("row", "vec_id", "node"), stored(facts, "facts"), ["node"])
    alone = F.col("node").isNull()
    out = out.select(
        "vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

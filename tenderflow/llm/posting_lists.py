"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split again and again at the median between two means, which gives clusters of even size; their means are the
centroids. Every vector goes to the list of its nearest centroid, and a boundary vector to further lists whose centroids are
about as near. A query finds near centroids by a best-first walk over
an in-memory graph of neighbouring centroids; lists much farther than the nearest are left out, by the ratio of distances, and
more are taken where those left hold too few vectors. Then vectors and queries meet list by list: the nearest lists first, whose k-th
best score bounds what the other lists send on.

Nearness is the inner product, in double precision. One more coordinate makes all vectors equally long, so that the nearest by
distance is the one of the largest inner product.

A long list is cut into parts, and so are its queries, so a task never holds more than a part of each: a third of all
vectors in one list only make more parts.

Null, zero and non-finite vectors, vectors with a null component, rows without an id, and vectors that are not of the most
common length take no part. Of repeated ids each row counts as a candidate once, by its best score. Only id and vector are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderflow.llm.common import stored, table, uniform

#: Sample for the centroids, lists at most, vectors aimed at in a list.
SAMPLE, MOST_LISTS, LIST_SIZE = 20_000, 4096, 400
#: Boundary: lists of one vector, and how much farther than the nearest they may be.
REPLICAS, BOUNDARY = 3, 0.06
#: Search: least width of the walk and least part of all lists, how much farther than the nearest list, and times k that the lists must hold.
WIDTH, PART_WALKED, RATIO, HELD = 128, 0.75, 0.1, 20
#: Vectors and queries of a list that meet in one task.
PART_VECTORS, PART_QUERIES = 8_000, 4_000
#: Lists of a query whose k best bound what its other lists send on.
FIRST = 4
DEGREE = 16


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of clusters of even size: the largest cluster is halved until there are enough."""
    rng = np.random.Generator(np.random.PCG64(seed))
    heap = [(-len(x), 0, np.arange(len(x)))]
    n = 1
    while len(heap) < lists and -heap[0][0] > 1:
        _, _, own = heapq.heappop(heap)
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(6):
            d = distances(x[own], np.stack([a, b]))
            order = np.argsort(d[:, 0] - d[:, 1], kind="stable")
            half = len(own) // 2
            a, b = x[own[order[:half]]].mean(0), x[own[order[half:]]].mean(0)
        for part in (own[order[:half]], own[order[half:]]):
            heapq.heappush(heap, (-len(part), n, part))
            n += 1
    return np.stack([x[own].mean(0) for _, _, own in heap])


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # (lists, degree): neighbours of each centroid
    entries: np.ndarray
    length2: float  # squared length that the added coordinate brings every vector to
    sizes: np.ndarray | None = None

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = (x * x).sum(1)
        return np.hstack([x, np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(self.length2 - own, 0))[:, None]])


def build(sample: np.ndarray, lists: int, length2: float) -> Index:
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), length2)
    index.centroids = c = balanced_centroids(index.lifted(sample, False), lists)
    near = np.argsort(distances(c, c), axis=1, kind="stable")[:, 1 : DEGREE + 1]
    # Some far links too, so that the walk can leave a cluster of centroids.
    rng = np.random.Generator(np.random.PCG64(7))
    far = rng.integers(0, len(c), (len(c), 4))
    index.graph = np.hstack([near, far])
    index.entries = np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(int))
    return index


def assign(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists of each vector, nearest first."""
    d = distances(index.lifted(x, False), index.centroids)
    most = min(REPLICAS, d.shape[1])
    best = np.argsort(d, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(d, best, 1)
    ok = near <= near[:, :1] * (1 + BOUNDARY) + 1e-12
    row, place = np.nonzero(ok)
    return row, best[row, place]


def walk(index: Index, q: np.ndarray, width: int) -> list[tuple[float, int]]:
    """The nearest centroids to a lifted query that a best-first walk of that width finds, nearest first."""
    def far(nodes: np.ndarray) -> list[float]:
        d = index.centroids[nodes] - q
        return np.sqrt((d * d).sum(1)).tolist()

    seen = set(index.entries.tolist())
    todo = list(zip(far(index.entries), index.entries.tolist(), strict=True))
    heapq.heapify(todo)
    best = [(-d, i) for d, i in todo]
    heapq.heapify(best)
    while len(best) > width:
        heapq.heappop(best)
    while todo:
        d, node = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        fresh = [i for i in dict.fromkeys(index.graph[node].tolist()) if i not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for d, i in zip(far(np.array(fresh)), fresh, strict=True):
            if len(best) < width or d < -best[0][0]:
                heapq.heappush(todo, (d, i))
                heapq.heappush(best, (-d, i))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-d, i) for d, i in best)


def chosen(index: Index, q: np.ndarray, k: int) -> list[int]:
    """Lists to search: within the ratio of the nearest, and more until they hold enough; all of them if need be."""
    found = walk(index, q, max(WIDTH, int(PART_WALKED * len(index.centroids))))
    least = found[0][0]
    out, held = [], 0
    for d, i in found:
        if d > least * (1 + RATIO) + 1e-12 and held >= HELD * k:
            break
        out.append(i)
        held += int(index.sizes[i])
    if held < HELD * k and len(out) < len(index.centroids):
        d = np.linalg.norm(index.centroids - q, axis=1)
        for i in np.argsort(d, kind="stable").tolist():
            if held >= HELD * k:
                break
            if i not in set(out):
                out.append(i)
                held += int(index.sizes[i])
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("v"), bad.alias("_bad"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.col("_bad") & F.exists("v", lambda x: x != 0)).drop("_bad")
    common = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df.where(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_list())
    return column.flatten().to_numpy().reshape(len(column), -1)


def neighbours(vectors: DataFrame, k: int, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). `is_query` is a condition on a column vec_id."""
    spark = vectors.sparkSession
    df = stored(usable(vectors, vec_id, embedding), "vectors")
    facts = df.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("length2")).first()
    result = "query_id long, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = df.where(uniform(F.lit("fit"), F.col("vec_id")) < F.lit(SAMPLE / facts["n"])).select("v").limit(2 * SAMPLE).toArrow()
    if not len(rows):
        rows = df.select("v").limit(1).toArrow()
    sample = matrix(rows.column(0).combine_chunks())
    index = build(sample, max(1, min(MOST_LISTS, facts["n"] // LIST_SIZE, len(sample))), facts["length2"])
    shared = spark.sparkContext.broadcast(index)

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2000):
                own = batch.slice(first, 2000)
                row, to = assign(shared.value, matrix(own.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row))], ["list", "vec_id", "v"])

    lists = stored(df.mapInArrow(to_lists, "list int, vec_id long, v array<double>"), "lists")
    # One row per list, MOST_LISTS at most.
    sizes = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
    index.sizes = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    searched = spark.sparkContext.broadcast(index)

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = searched.value.lifted(matrix(batch.column(1)), True)
                to = [chosen(searched.value, q, k) for q in own]
                row = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
                place = np.concatenate([np.arange(len(x)) for x in to]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(to).astype(np.int32)), pa.array(place), batch.column(0).take(row), batch.column(1).take(row)],
                    ["list", "place", "query_id", "q"],
                )

    queries = df.where(is_query).dropDuplicates(["vec_id"]).repartition("vec_id")
    asked = queries.mapInArrow(to_queries, "list int, place int, query_id long, q array<double>")
    asked = stored(asked, "asked")
    many = asked.groupBy(F.col("list").alias("_list")).agg(F.ceil(F.count("*") / F.lit(PART_QUERIES)).cast("int").alias("q_parts"))
    long = lists.groupBy(F.col("list").alias("_long")).agg(F.ceil(F.count("*") / F.lit(PART_VECTORS)).cast("int").alias("v_parts"))
    parts = F.broadcast(stored(many.join(long, F.col("_list") == F.col("_long")).select("_list", "q_parts", "v_parts"), "parts"))
    right = lists.join(parts, F.col("list") == F.col("_list")).withColumn(
        "vp", F.pmod(F.xxhash64("vec_id"), F.col("v_parts")).cast("int")
    ).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("list", "qp", "vp", "vec_id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, floor = matrix(a["q"]), matrix(b["v"]), a["least"].to_numpy()
        ids = b["vec_id"].to_numpy()
        enough = k + len(ids) - len(np.unique(ids))  # so many rows hold k ids, however often an id is repeated
        out = []
        for first in range(0, len(q), 256):
            some = q[first : first + 256]
            scores = some @ v.T
            for i, query in enumerate(a["query_id"].to_numpy()[first : first + 256]):
                s = scores[i]
                s[ids == query] = -np.inf
                # The product's rounding depends on the place in the matrix; candidates are scored again one by one.
                bound = max(np.partition(s, -enough)[-enough] if len(s) > enough else -np.inf, floor[first + i])
                at = np.flatnonzero((s >= bound - 1e-9 * max(1.0, abs(bound)) if np.isfinite(bound) else True) & np.isfinite(s))
                exact = (v[at] * some[i]).sum(1)
                order = np.lexsort((ids[at], -exact))
                order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
                out.append((np.full(len(order), query), ids[at][order], exact[order]))
        return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["list", "qp", "vp"]

    def searched_lists(some: DataFrame) -> DataFrame:
        """Best candidates of each query and list part that reach the query's bound `least`."""
        left = some.join(parts, F.col("list") == F.col("_list")).withColumn("qp", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int"))
        left = left.withColumn("vp", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1))).select(*keys, "query_id", "q", "least")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, result)
        return stored(found, "found")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    near = searched_lists(asked.where(F.col("place") < FIRST).withColumn("least", F.lit(float("-inf"))))
    bounds = stored(ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("_least")), "bounds")
    others = asked.where(F.col("place") >= FIRST).join(bounds, F.col("query_id") == F.col("_query"), "left")
    far = searched_lists(others.withColumn("least", F.coalesce("_least", F.lit(float("-inf")))))
    return ranked(near.union(far)).select("query_id", "rank", "vec_id", "score")


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)

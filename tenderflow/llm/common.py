"""What the corpus operators share: tables, stored intermediate results, checked lookups, order and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup side up to which it is sent to every executor. Its size is counted first; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{shared.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder as Parquet and read it back: the lineage ends in files, which a lost executor does not take along."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing will read any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a table with one row per key; nulls match nulls.

    The lookup is broadcast only when it has at most `limit` rows, which is counted first. A larger one is joined by a
    shuffle; both sides then reach the join through exchanges of its own, so that the adaptive skew join can split
    a hot key. `lookup` should be stored, since it is read twice.
    """
    other = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in lookup.columns if c not in keys])
    small = other.limit(limit + 1).count() <= limit
    match = None
    for k in keys:
        same = df[k].eqNullSafe(F.col(f"_k_{k}"))
        match = same if match is None else match & same
    return df.join(F.broadcast(other) if small else other, match, "left").drop(*[f"_k_{k}" for k in keys])


def keep_ids(df: DataFrame, key: str, ids: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Rows whose key is in the one-column table `ids` (stored); broadcast only when it has at most `limit` rows."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that follows from the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def running_total(df: DataFrame, order: list[str], value: str, out: str, name: str = "order") -> DataFrame:
    """Add the sum of the integer column `value` over all rows before, in the order of `order`, which should be unique.

    The rows are range partitioned and sorted, and summed up range by range as they stream by; one total per range is all
    that is added up as a whole. The ranges are stored first, since a second sampling could cut them elsewhere.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("_range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False)).astype(np.int64)
            ahead = before + np.concatenate([[0], sums[:-1]]).astype(np.int64) if len(sums) else sums
            before += int(sums[-1]) if len(sums) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ahead), pa.array(np.full(len(sums), own, np.int32))], [*batch.schema.names, out, "_range"])

    ranged = stored(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    # One row per range: as many as there are shuffle partitions.
    summed = ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return summed.select(*df.columns, (F.col(out) + F.col("_before")).cast("bigint").alias(out))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each one reaches over the links (a, b). Nodes without a link are left out.

    Large-star and small-star steps in turn: every node ties its larger neighbours to its smallest, then itself and its
    smaller neighbours. Each round is stored; the end is a round that changes nothing.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.col("_u")).alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        forget(least, edges)
        least = stored(large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")), "least")
        tied = large.join(least, F.col("u") == F.col("_u"))
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        )
        edges = stored(small.where("u <> v").distinct(), "small")
        forget(large, least)
        now = mark(edges)
        if now == last:
            members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def segment_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, str], name: str = "sums") -> DataFrame:
    """Add running sums within each key, own row included: out column -> integer column. Sums wrap at 64 bits.

    Rows are range partitioned by keys and order, so one key may fill many ranges; each range is summed up as it streams by. Only the
    first and last row of each range reach the driver, from which follows what a key brings along from earlier ranges.
    """
    spark = df.sparkSession
    outs = list(sums)
    extra = [*[T.StructField(o, T.LongType()) for o in outs], T.StructField("_range", T.IntegerType()), T.StructField("_head", T.BooleanType()), T.StructField("_edge", T.IntegerType())]
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last_key, ahead, head, waiting, first = TaskContext.get().partitionId(), None, np.zeros(len(outs), np.int64), True, None, True
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            starts = np.zeros(n, bool)
            for k in keys:
                col = batch.column(k)
                a, b = col.slice(1), col.slice(0, n - 1)
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
                starts[1:] |= differs
            key = tuple(batch.column(k)[0].as_py() for k in keys)
            fresh = first or key != last_key
            starts[0] = fresh
            segment = np.cumsum(starts)  # 0: goes on from the batch before
            begin = np.flatnonzero(starts)
            columns = []
            with np.errstate(over="ignore"):
                for j, o in enumerate(outs):
                    value = batch.column(sums[o]).to_numpy(zero_copy_only=False).astype(np.int64)
                    total = np.cumsum(value, dtype=np.int64)
                    base = np.concatenate([[-ahead[j]], total[begin] - value[begin]])
                    columns.append(total - base[segment])
            if not first and fresh:
                head = False
            heads = (segment <= (1 if first else 0)) & head
            head = bool(heads[-1])
            edge = np.zeros(n, np.int32)
            if first:
                edge[0] = 1
            out = [*batch.columns, *[pa.array(c) for c in columns], pa.array(np.full(n, own, np.int32)), pa.array(heads)], edge
            ahead = np.array([c[-1] for c in columns], np.int64)
            last_key, first = tuple(batch.column(k)[n - 1].as_py() for k in keys), False
            if waiting is not None:
                yield pa.RecordBatch.from_arrays([*waiting[0], pa.array(waiting[1])], schema.names)
            waiting = out
        if waiting is not None:
            waiting[1][-1] += 2
            yield pa.RecordBatch.from_arrays([*waiting[0], pa.array(waiting[1])], schema.names)

    cut = [*[F.col(k) for k in keys], *order]
    ranged = stored(df.repartitionByRange(*cut).sortWithinPartitions(*cut).mapInArrow(run, schema), name)
    edges = ranged.where("_edge > 0").select("_range", "_edge", "_head", F.struct(*keys).alias("k"), *outs).orderBy("_range", "_edge").collect()
    carry: dict[int, np.ndarray] = {}
    before, held = None, np.zeros(len(outs), np.int64)
    with np.errstate(over="ignore"):
        for row in edges:  # two rows for each range, or one for a range of one row
            if row["_edge"] & 1:
                carry[row["_range"]] = held if row["k"] == before else np.zeros(len(outs), np.int64)
            if row["_edge"] & 2:
                held = np.array([row[o] for o in outs], np.int64) + (carry[row["_range"]] if row["_head"] else 0)
                before = row["k"]
    brought = spark.sparkContext.broadcast(carry)
    kept = [f for f in schema.fields if f.name not in ("_range", "_head", "_edge")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ranges, heads = batch.column("_range").to_numpy(), batch.column("_head").to_numpy(zero_copy_only=False)
            numbers, at = np.unique(ranges, return_inverse=True)
            more = np.stack([brought.value[int(r)] for r in numbers])[at] * heads[:, None]
            with np.errstate(over="ignore"):
                new = [pa.array(batch.column(o).to_numpy() + more[:, j]) for j, o in enumerate(outs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept if f.name not in outs], *new], [f.name for f in kept])

    return ranged.mapInArrow(add, T.StructType(kept))

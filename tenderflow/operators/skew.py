"""Joins and matches that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.session import cut_lineage

#: Left rows are cut into about that many slices at least, down to LEAST_SLICE rows each; and partitions that cells are dealt to at most.
SLICES, LEAST_SLICE, MOST_PARTITIONS = 48, 250, 2_000


def lookup_join(probe: DataFrame, lookup: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join of `probe` to `lookup`, which has one row per key, that holds when one key has a large share of the probe.

    The adaptive skew join splits a hot partition of the probe, but only when both sides reach the join through a
    shuffle of the join itself. A lookup is mostly an aggregate by its key, whose own shuffle would be reused, and
    then nothing is split. Joining on an expression of the key gives each side a shuffle of its own: the lookup, one
    row per key, moves once more, and the hot rows of the probe are read by many tasks. Rows without a key find
    nothing and are split the same way.
    """
    found = lookup.select(
        F.concat(F.col(key).cast("string"), F.lit("\u0001")).alias("_lookup_key"), F.struct(*values).alias("_lookup_value")
    )
    joined = probe.join(found, F.concat(F.col(key).cast("string"), F.lit("\u0001")) == F.col("_lookup_key"), "left")
    return joined.select(*probe.columns, *[F.col("_lookup_value")[v].alias(v) for v in values])


def block_match(
    left: DataFrame,
    right: DataFrame,
    group: str,
    match: Callable,
    schema: str,
    *,
    left_block: int = 20_000,
    right_block: int = 50_000,
) -> DataFrame:
    """Compare every left row with the right rows of its group, one bounded block at a time.

    `match(left_pdf, right_pdf)` returns at most a few rows per left row (a best match, never the pairs). A group
    that is larger than a block is cut into left slices and right blocks; each task sees one of each, and
    the caller folds the partial results per left row. A group that only one side has never reaches a task.
    The rows are few bytes and much work, so the number of tasks follows the number of cells to compare, not the bytes, by
    which adaptive execution would put them all into one task.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    left_block = min(left_block, max(LEAST_SLICE, -(-left.count() // SLICES)))
    nl = left.groupBy(group).agg(F.count("*").alias("_nl"))
    nr = right.groupBy(group).agg(F.count("*").alias("_nr"))
    # Groups that only one side has meet nothing and leave here; every other one gets its numbers of slices and blocks.
    sizes = nl.join(nr, group).select(
        F.col(group).alias("_sized"),
        F.ceil(F.col("_nl") / F.lit(left_block)).cast("int").alias("_slices"),
        F.ceil(F.col("_nr") / F.lit(right_block)).cast("int").alias("_blocks"),
    )
    sizes = cut_lineage(sizes)
    cells = sizes.agg(F.sum(F.col("_slices").cast("bigint") * F.col("_blocks"))).first()[0] or 0
    tasks = max(1, min(2 * cells, MOST_PARTITIONS))

    def cut(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        sized = df.join(sizes, F.col(group) == F.col("_sized"))
        mine = F.pmod(F.xxhash64(*df.columns), F.col(own_n)).cast("int")
        copies = F.sequence(F.lit(0), F.col(other_n) - 1)
        return sized.withColumn(own, mine).withColumn(other, F.explode(copies)).drop("_sized", "_slices", "_blocks")

    lefts = cut(left, "_slice", "_slices", "_block", "_blocks")
    rights = cut(right, "_block", "_blocks", "_slice", "_slices")
    keys = [group, "_slice", "_block"]

    def run(lp, rp):
        return match(lp.drop(columns=["_slice", "_block"]), rp.drop(columns=["_slice", "_block"]))

    return lefts.repartition(tasks, *keys).groupBy(*keys).cogroup(rights.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, schema)

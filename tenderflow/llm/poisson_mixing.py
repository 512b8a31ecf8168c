"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share over its share of the corpus. Each document's count is the inverse of
the Poisson distribution with that mean at a number that a hash of seed and row gives, so a run, a retry and a lost executor give the same
counts. Documents are exploded by their count and dealt out in the order of another hash: a random permutation of all copies.

A mean above `PART` is a sum of equal parts with a number each, which keeps the tables of the distribution short and exact.

Nulls: a null source is a source of its own, a null text has size 0. Rows that are equal in id and text get equal counts. A source
without a weight, or with a weight of 0, gets no copies; the weights are scaled to sum 1 over the sources that occur. The other
columns pass through under any names; an added column (copy, rate, mix_key) whose name is taken, in whatever case, starts with "mix_".
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import stored, table, uniform, with_lookup

PART = 16.0


def _steps() -> int:
    """Entries after which the rest of the distribution with mean PART is below the resolution of the hashed number."""
    k, p, rest = 0, math.exp(-PART), 1.0
    while rest > 2.0**-56 or k < PART:
        rest, k = rest - p if rest - p > 0 else 0.0, k + 1
        p = p * PART / k
        if p < 2.0**-70 and k > PART:
            break
    return k


STEPS = _steps()


def distribution(mean: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... for a mean of at most PART."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(done: Column, k: Column) -> Column:
        p = done["p"] * mean / k
        return F.struct(p.alias("p"), (done["sum"] + p).alias("sum"), F.array_append(done["all"], done["sum"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step)["all"]


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text", unit: str = "chars") -> DataFrame:
    """(source, n_docs, size): size counts characters, or documents with unit="docs"."""
    size = F.sum(F.coalesce(F.length(text), F.lit(0))) if unit == "chars" else F.count("*")
    return stored(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"), size.alias("size")), "sizes")


def tempered(sizes: DataFrame, power: float) -> DataFrame:
    """(source, weight): shares of the corpus raised to a power below 1, which lifts small sources."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(power)).alias("weight"))


def rates(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean repetitions, for a mix `epochs` times the size of the corpus."""
    df = with_lookup(sizes, weights.select("source", F.col("weight").alias("_w")), ["source"])
    df = df.withColumn("_w", F.when(F.col("size") > 0, F.greatest(F.coalesce(F.col("_w"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    total = df.agg(F.sum("_w").alias("w"), F.sum("size").alias("s")).first()
    scale = epochs * float(total["s"]) / total["w"] if total["w"] else 0.0
    return stored(df.select("source", F.when(F.col("size") > 0, F.col("_w") * F.lit(scale) / F.col("size")).otherwise(0.0).alias("rate")), "rates")


def free_names(names: list[str], taken: list[str], prefix: str = "mix_") -> dict[str, str]:
    """Each name, or with as many prefixes as it takes to clash with none of `taken`; case does not tell names apart."""
    used, out = {t.lower() for t in taken}, {}
    for name in names:
        free = name
        while free.lower() in used:
            free = prefix + free
        out[name] = free
        used.add(free.lower())
    return out


def replicate(docs: DataFrame, rate: DataFrame, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with copy (from 1), rate and mix_key: one row per copy, in the order of mix_key within randomly dealt partitions."""
    name = free_names(["copy", "rate", "mix_key"], docs.columns)
    # All given columns travel in one struct, so that no name of theirs meets one used here.
    df = docs.select(F.struct(*docs.columns).alias("given"), F.col(source).alias("source"), F.xxhash64(F.lit(seed), doc_id, text).alias("row"))
    tables = stored(
        rate.withColumn("parts", F.greatest(F.ceil(F.col("rate") / F.lit(PART)), F.lit(1)).cast("int")).select(
            "source", F.struct("rate", "parts", distribution(F.col("rate") / F.col("parts")).alias("cdf")).alias("poisson")
        ),
        "poisson",
    )
    df = with_lookup(df, tables, ["source"])
    drawn = F.transform(F.sequence(F.lit(1), F.col("poisson.parts")), lambda j: F.size(F.filter(F.col("poisson.cdf"), lambda c: c <= uniform(F.col("row"), j))))
    df = df.withColumn("count", F.aggregate(drawn, F.lit(0), lambda a, x: a + x)).where("count > 0")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    df = df.withColumn("key", F.xxhash64(F.lit(seed + 1), "row", "copy"))
    dealt = df.repartition("key").sortWithinPartitions("key")
    return dealt.select(
        "given.*", F.col("copy").alias(name["copy"]), F.col("poisson.rate").alias(name["rate"]), F.col("key").alias(name["mix_key"])
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 17, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mix to the given (source, weight) table, or to tempered shares of the corpus."""
    sizes = source_sizes(docs, source, text)
    return replicate(docs, rates(sizes, tempered(sizes, power) if weights is None else weights, epochs), seed, doc_id, text, source)


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), power=0.5)

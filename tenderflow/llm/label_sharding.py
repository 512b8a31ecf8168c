"""Sharding by balanced label propagation.

Every document starts in a shard that a hash of its id gives. In each round it looks at its neighbours' shards and asks to move to the
one where most of them are, if that is more than share its own. Moves from shard to shard are granted up to a quota: as many as move the other way,
plus what the target lacks and the source has over. A hash decides who moves within the quota, so no ranking of all movers is
needed. After the rounds, documents over a shard's exact share, those without links first, fill the shards that lack some.

Links come as (group) memberships: the members of a group are linked with each other. Neighbours are counted per group and shard, so
a group of a third of all documents costs one row per shard, not its pairs, and is cut only where it exceeds a shard's share.

The law is `rows`: shard sizes differ by one document at most. Slots number a shard's documents from 0.

Nulls: a null text has no bytes and no links. Repeated rows are documents of their own, linked if their texts are equal. A null id stays
null. Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderflow.llm.common import running_total, stored, table, uniform

SHARDS, ROUNDS = 24, 6


def members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, grp): one row per document; grp is null where no other document has the text."""
    df = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.md5(F.col(text).cast("binary"))).alias("key"),
    )
    df = stored(df, "members")
    several = stored(df.where("key IS NOT NULL").groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n"), F.min("row").alias("grp")).where("_n > 1"), "groups")
    return stored(df.join(several.select("_key", "grp"), F.col("key") == F.col("_key"), "left").drop("key", "_key"), "members")


def start(linked: DataFrame, shards: int) -> DataFrame:
    return linked.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))


def wishes(labels: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """Per group and shard: of the shards with room, the one most of the group is in, and how many more neighbours that has."""
    cells = stored(labels.groupBy("grp", "shard").agg(F.count("*").alias("k")), "cells")
    # One row per shard.
    room = F.broadcast(counts.where(F.col("rows") + 1 <= share).select("shard"))
    top = cells.join(room, "shard").groupBy(F.col("grp").alias("_grp")).agg(F.max(F.struct(F.col("k"), (-F.col("shard")).alias("s"))).alias("top"))
    df = cells.join(top, F.col("grp") == F.col("_grp"))
    df = df.withColumns({"target": (-F.col("top.s")).cast("int"), "gain": F.col("top.k") - (F.col("k") - 1)})
    return df.where((F.col("target") != F.col("shard")) & (F.col("gain") > 0)).select("grp", "shard", "target", "k", "gain")


def granted(asked: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """Per (shard, target): the part of the movers that may go. At most shards squared rows."""
    flow = asked.groupBy("shard", "target").agg(F.sum("k").alias("n"))
    back = flow.select(F.col("target").alias("_s"), F.col("shard").alias("_t"), F.col("n").alias("_back"))
    room = counts.select(F.col("shard").alias("_room"), F.greatest(F.lit(share) - F.col("rows"), F.lit(0.0)).alias("lacks"))
    over = counts.select(F.col("shard").alias("_over"), F.greatest(F.col("rows") - F.lit(share), F.lit(0.0)).alias("spare"))
    into = flow.groupBy(F.col("target").alias("_into")).agg(F.sum("n").alias("asked"))
    df = flow.join(back, (F.col("shard") == F.col("_s")) & (F.col("target") == F.col("_t")), "left")
    df = df.join(room, F.col("target") == F.col("_room"), "left").join(over, F.col("shard") == F.col("_over"), "left").join(into, F.col("target") == F.col("_into"), "left")
    quota = F.least(F.col("n"), F.coalesce("_back", F.lit(0)) + F.col("lacks") * F.col("n") / F.col("asked") + F.col("spare") * F.col("n") / F.col("asked"))
    return stored(df.select("shard", "target", (quota / F.col("n")).alias("part")), "quota")


def propagate(linked: DataFrame, n_rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, grp, shard) of the linked documents after the rounds. Unlinked ones count towards capacity as a filling that can go anywhere."""
    labels = stored(start(linked, shards), "labels")
    share = n_rows / shards
    for turn in range(rounds):
        counts = labels.groupBy("shard").agg(F.count("*").alias("rows"))
        counts = stored(shard_ids(labels, shards).join(counts, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows")), "counts")
        asked = stored(wishes(labels, counts, share), "wishes")
        if asked.isEmpty():
            break
        part = granted(asked, counts, share)
        moves = asked.join(F.broadcast(part), ["shard", "target"]).select(F.col("grp").alias("_grp"), F.col("shard").alias("_shard"), "target", "part")
        moves = stored(moves, "moves")
        df = labels.join(moves, (F.col("grp") == F.col("_grp")) & (F.col("shard") == F.col("_shard")), "left")
        # Members of one cell move together where the quota allows it, else a part of them.
        goes = uniform(F.lit(turn), F.when(F.col("part") >= 1, F.col("grp")).otherwise(F.col("row"))) < F.col("part")
        labels = stored(df.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).select("row", "grp", "shard"), "labels")
    return labels


def cut_edges(labels: DataFrame) -> DataFrame:
    """One row: pairs of linked documents, and those in different shards."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = labels.groupBy("grp", "shard").agg(F.count("*").alias("k")).groupBy("grp").agg(F.sum("k").alias("n"), F.sum(pairs("k")).alias("kept"))
    return cells.agg(F.sum(pairs("n")).alias("links"), F.sum(pairs("n") - F.col("kept")).alias("cut"))


def places(df: DataFrame, order: list[str]) -> DataFrame:
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", "place", "places").drop("_one")


def filled(linked: DataFrame, loose: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """(row, shard, slot): exact shares. Linked documents over their shard's share go with the loose ones to where some lack."""
    small = n_rows // shards
    want = F.when(F.col("shard") < n_rows % shards, F.lit(small + 1)).otherwise(F.lit(small))
    ordered = places(linked.select("row", "grp", "shard"), ["shard", "grp", "row"])
    ordered = stored(ordered, "ordered")
    counts = ordered.groupBy("shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # One row per shard from here on.
    base = shard_ids(ordered, shards).join(counts, "shard", "left").select("shard", F.coalesce("first", F.lit(0)).alias("first"), F.least(F.coalesce("n", F.lit(0)), want).alias("stay"), want.alias("want"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    lacks = F.col("want") - F.col("stay")
    base = stored(base.withColumn("lack_first", F.coalesce(F.sum(lacks).over(before), F.lit(0))).withColumn("lack", lacks), "shares")
    known = F.broadcast(base.select(F.col("shard").alias("_s"), "first", "stay"))
    settled = ordered.join(known, F.col("shard") == F.col("_s")).withColumn("slot", F.col("place") - F.col("first"))
    stay = settled.where(F.col("slot") < F.col("stay")).select("row", "shard", "slot")
    # Members of a group that must leave stay together: by group, then row.
    moving = settled.where(F.col("slot") >= F.col("stay")).select(F.coalesce("grp", F.lit(-1)).alias("grp"), "row")
    rest = moving.union(loose.select(F.lit(1 << 62).alias("grp"), "row"))
    dealt = places(rest, ["grp", "row"])
    gaps = F.broadcast(base.where("lack > 0").select(F.col("shard").alias("shard"), "stay", "lack_first", "lack"))
    went = dealt.join(gaps, (F.col("place") >= F.col("lack_first")) & (F.col("place") < F.col("lack_first") + F.col("lack")))
    return stay.union(went.select("row", "shard", (F.col("stay") + F.col("place") - F.col("lack_first")).alias("slot")))


def shard_ids(df: DataFrame, shards: int) -> DataFrame:
    return df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grp)."""
    own = members(docs, doc_id, text)
    n_rows = own.count()
    linked = own.where("grp IS NOT NULL").select("row", "grp")
    labels = propagate(linked, n_rows, shards, rounds)
    at = stored(filled(labels, own.where("grp IS NULL").select("row"), n_rows, shards), "placed").withColumnRenamed("row", "_row")
    return own.join(at, F.col("row") == F.col("_row")).select("doc_id", "size", "text_crc32", "shard", "slot", "grp")


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    none: Column = F.lit(None).cast("int")
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), none.alias("grown_shard")
    )

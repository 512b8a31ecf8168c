"""N-gram Jaccard join with grouped prefixes, and the components of its links.

Documents are sets of word shingles. Two sets of similarity s or more share a member of their prefixes, whatever common order the
members are sorted by. The order here puts shingles that many documents hold last, so the lists of prefix members stay short.

1. Frequent shingles: every task counts the shingles of its documents block by block and passes on those that a block holds a few times; the
   counts are summed over the corpus, and a bounded number of the most frequent ones forms the end of the order. A shingle that is missed
   only makes a list longer; the result does not depend on the order.
2. Documents of equal sets collapse to one node, nodes of equal prefix and size to one group. Only groups are dealt by prefix members.
3. Star: in each list, every group is paired with the smallest one; pairs are filtered by size and by the parity signature (two sets that
   differ in k members differ in at most k bits), expanded to members and verified on whole sets. Links make components.
4. Rest: in lists whose nodes are in several components, each node outside the largest one is compared with the nodes of other
   components; the same filters and the same verification follow. Pairs within a component need no look, so a group of thousands of near
   copies costs a star, not all its pairs, and no link between components is missed.

Hot lists: a list of a third of all documents meets a join by its shingle, which the adaptive skew join splits.

Nulls and empty texts have no words: they are linked with nothing and are their own component. Repeated rows are equal sets and so linked.
Null ids are left as they are: a component's id is its smallest id that is not null. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import components, forget, keep_ids, stored, table
from tenderflow.llm.shingles import BITS, apart, big_signature, least_prefix, shingles, signature
from tenderflow.llm.tokens import in_batches

PERCENT = 80
#: Frequent shingles in the order, at most: bounds what is sent to every executor (16 bytes each).
MOST_FREQUENT = 200_000
#: Times in a block before a task passes a count on, and times in all before a shingle counts as frequent.
LOCAL_TIMES, TIMES = 3, 12
WORDS = BITS // 64
#: Sets of more members than this also get a signature of two to four bits a member: the common one says little about them.
LONG = 1500
#: Open prefix members that a row of the last step carries along, so that a pair is made once.
MOST_HELD = 256


def encoded(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    for part in in_batches(column):
        yield part.first, [(t or "").encode() for t in part.texts]


def frequent_shingles(docs: DataFrame, text: str = "text", most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` hashes, ascending, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL_TIMES
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for batch in batches:
            for _, texts in encoded(batch.column(0)):
                h, _ = shingles(texts)
                held.append(h)
                size += len(h)
                if size >= 2_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)
    rows = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


SETS = f"doc_id long, n long, f1 long, f2 long, g1 long, g2 long, prefix array<long>, big binary, {', '.join(f's{i} long' for i in range(WORDS))}"


def halves(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist())


def described(docs: DataFrame, doc_id: str, text: str, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: size, fingerprints of the set (f1, f2) and of prefix and size (g1, g2), the prefix, the signature."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, texts in encoded(batch.column(1)):
                h, own = shingles(texts)
                rank = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    rank = np.where(often[at] == h, times[at], 0)
                order = np.lexsort((h, rank, own))
                sorted_h = h[order]
                n = np.bincount(own, minlength=len(texts))
                begin = np.cumsum(n) - n
                rows, prefixes, signs, bigs = [], [], [], []
                for i, (b, k) in enumerate(zip(begin.tolist(), n.tolist(), strict=True)):
                    prefix = sorted_h[b : b + least_prefix(k, percent)]
                    rows.append((k, *halves(h[b : b + k].tobytes()), *halves(prefix.tobytes() + k.to_bytes(8, "little"))))
                    prefixes.append(prefix)
                    signs.append(signature(h[b : b + k]))
                    bigs.append(big_signature(h[b : b + k]) if k > LONG else None)
                lengths = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                columns = [ids.slice(first, len(texts)), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]]
                columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefixes).view(np.int64))))
                columns.append(pa.array(bigs, pa.binary()))
                columns += [pa.array(x) for x in np.ascontiguousarray(np.array(signs).T)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, SETS)


def whole_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(f1, f2, members) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in encoded(batch.column(1)):
                h, own = shingles(texts)
                n = np.bincount(own, minlength=len(texts))
                at = np.concatenate([[0], np.cumsum(n)])
                prints = [halves(h[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x, pa.int64()) for x in zip(*prints, strict=True)], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))],
                    ["f1", "f2", "members"],
                )

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "f1 long, f2 long, members array<long>")


def may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and signatures allow the similarity. `a` and `b` name structs with n and the signature."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    # |x ^ y| <= (|x| + |y|) * (1 - t) / (1 + t)
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (differ * F.lit(100 + percent) <= (n + m) * F.lit(100 - percent))


class Join:
    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT):
        self.docs, self.doc_id, self.text, self.percent = docs, doc_id, text, percent
        frequent = frequent_shingles(docs, text)
        sets = described(docs, doc_id, text, percent, frequent).withColumn("row", F.monotonically_increasing_id())
        self.sets = stored(sets, "sets")

    def group(self) -> None:
        """Nodes (equal sets) and groups (equal prefix and size); a node is named by a row of its own, a group by a node."""
        keys = ["f1", "f2", "g1", "g2", "n"]
        nodes = self.sets.where("n > 0").groupBy(*keys).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
        nodes = stored(nodes, "nodes")
        groups = stored(nodes.groupBy("g1", "g2").agg(F.min("node").alias("gid"), F.count("*").alias("members")), "groups")
        at = groups.select(F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "gid", "members")
        self.nodes = stored(nodes.join(at, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2"))).drop("_g1", "_g2"), "nodes")
        forget(nodes, groups)
        # Rows that are not the one their group is named by.
        firsts = self.nodes.where("node = gid").select("node")
        others = self.others = stored(self.sets.where("n > 0").select("row").join(firsts, F.col("row") == F.col("node"), "left_anti"), "others")
        small = others.limit(2_000_001).count() <= 2_000_000
        lists = self.sets.where("n > 0").select("row", "n", "prefix").join(F.broadcast(others) if small else others, "row", "left_anti")
        self.postings = lists.select(F.col("row").alias("gid"), F.explode("prefix").alias("token"))
        self.signs = self.sets.select("row", F.struct("n", *[f"s{i}" for i in range(WORDS)]).alias("sign"))

    def lists(self) -> None:
        """Rows (token, gid, hub, groups) of tokens that at least two groups share, and the multi-member groups."""
        held = self.postings.groupBy("token").agg(F.min("gid").alias("hub"), F.count("*").alias("groups")).where("groups > 1")
        held = stored(held.select(F.col("token").alias("_token"), "hub", "groups"), "held")
        self.rows = stored(self.postings.join(held, F.col("token") == F.col("_token")).drop("_token"), "lists")
        forget(held, self.others)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among stored pairs of nodes (a, b), on whole sets."""
        ends = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        named = stored(self.nodes.select("node", "f1", "f2", "least").join(ends, "node"), "named")
        ids = stored(named.select(F.col("least").alias(self.doc_id)).distinct(), "ids")
        rows = keep_ids(self.docs, self.doc_id, ids).select(self.doc_id, self.text)
        if not ids.where(F.col(self.doc_id).isNull()).isEmpty():
            # Nodes whose rows all have a null id, which no join by id finds.
            rows = rows.unionByName(self.docs.where(F.col(self.doc_id).isNull()).select(self.doc_id, self.text))
        found = whole_sets(rows, self.doc_id, self.text)
        at = named.select("node", F.col("f1").alias("_f1"), F.col("f2").alias("_f2"))
        at = F.broadcast(at) if at.limit(1_000_001).count() <= 1_000_000 else at
        members = stored(found.join(at, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))).select("node", "members"), "members")
        left, right = members.select(F.col("node").alias("a"), F.col("members").alias("x")), members.select(F.col("node").alias("b"), F.col("members").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        linked = F.lit(100) * both >= F.lit(self.percent) * (F.size("x") + F.size("y") - both)
        # Repeated rows give a node's set more than once.
        links = stored(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b").distinct(), "links")
        forget(pairs, ends, named, ids, members)
        return links

    def sharpened(self, pairs: DataFrame) -> DataFrame:
        """Pairs without those of two long sets whose longer signatures rule a link out."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
                signs = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
                keep = [x is None or y is None or apart(x, y) * (100 + percent) <= (n + m) * (100 - percent) for (n, m), (x, y) in zip(sizes, signs, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        long = self.sets.where(F.col("n") > LONG)
        a, b = (long.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("big").alias(f"big_{x}")) for x in "ab")
        both = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "n_a", "big_a", "n_b", "big_b")
        sharp = stored(both.mapInArrow(run, "a long, b long"), "sharpened")
        forget(pairs)
        return sharp

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes whose sizes and signatures allow a link."""
        a = self.signs.select(F.col("row").alias("a"), F.col("sign").alias("x"))
        b = self.signs.select(F.col("row").alias("b"), F.col("sign").alias("y"))
        return pairs.join(a, "a").join(b, "b").where(may_link("x", "y", self.percent)).select("a", "b")

    def star(self) -> DataFrame:
        """Links of each node with the hubs of its lists, and with its group's first node."""
        groups = stored(self.rows.where("gid <> hub").select("gid", "hub").distinct(), "stars")
        own = self.nodes.select(F.col("gid").alias("_gid"), "node")
        # A group's members go with it; the hub's own members meet the hub in their group.
        across = groups.join(own, F.col("gid") == F.col("_gid")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        within = self.nodes.where("node <> gid").select(F.col("node").alias("a"), F.col("gid").alias("b"))
        every = stored(across.union(within).distinct(), "star")
        pairs = stored(self.filtered(every), "star")
        forget(groups, every)
        return self.verified(self.sharpened(pairs))

    def rest(self, links: DataFrame) -> DataFrame:
        """Links between different components of `links`."""
        label = stored(components(links), "components")
        several = self.nodes.where("members > 1").select("gid").distinct()
        busy = self.rows.where("groups > 2").select("token", "gid")
        # A list of two groups with one node each is settled by its star; one with a larger group is not.
        mixed_lists = self.rows.where("groups = 2").join(several, "gid", "left_semi").select("token").distinct()
        pairs_of_two = self.rows.where("groups = 2").join(mixed_lists, "token", "left_semi").select("token", "gid")
        # Larger groups also stand for themselves: their members share every prefix member.
        alone = several.select(F.col("gid").alias("token"), "gid")
        lists = stored(busy.union(pairs_of_two), "busy")
        own = self.nodes.select(F.col("gid").alias("_gid"), "node", "n")
        named = stored(own.join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("_gid", "node", "n", F.coalesce("component", "node").alias("comp")), "labelled")
        rows = lists.withColumn("kind", F.lit(0)).union(alone.withColumn("kind", F.lit(1))).join(named, F.col("gid") == F.col("_gid")).select("kind", "token", "node", "n", "comp")
        rows = stored(rows, "rows")
        forget(lists, named, label, self.rows)
        sizes = rows.groupBy("kind", "token", "comp").agg(F.count("*").alias("k"))
        main = sizes.groupBy("kind", "token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        main = stored(main.select(F.col("kind").alias("_kind"), F.col("token").alias("_token"), F.col("top.comp").alias("main")), "main")
        open_rows = rows.join(main, (F.col("kind") == F.col("_kind")) & (F.col("token") == F.col("_token"))).drop("_kind", "_token")
        opened = stored(open_rows, "open")
        forget(rows, main)
        # A pair is made at the least of the open tokens that both have, not at each; very long prefixes make it at each.
        held = opened.where("kind = 0").groupBy(F.col("node").alias("_node")).agg(F.collect_list("token").alias("held")).where(F.size("held") <= MOST_HELD)
        signed = opened.join(held, F.col("node") == F.col("_node"), "left").withColumn("held", F.when(F.col("kind") == 0, F.col("held"))).drop("_node")
        signed = stored(signed.join(self.signs.withColumnRenamed("row", "_row"), F.col("node") == F.col("_row")).drop("_row"), "open")
        forget(opened)
        side = lambda p: signed.select(F.col("kind").alias(f"{p}k"), F.col("token").alias(f"{p}t"), F.col("node").alias(p), F.col("comp").alias(f"{p}c"), F.col("main").alias(f"{p}m"), F.col("sign").alias(f"{p}s"), F.col("held").alias(f"{p}h"))
        a, b = side("a").where("ac <> am"), side("b")
        once = (F.col("bc") == F.col("bm")) | (F.col("a") < F.col("b"))
        first = F.coalesce(F.array_min(F.array_intersect("ah", "bh")) == F.col("at"), F.lit(True))
        pairs = a.join(b, (F.col("at") == F.col("bt")) & (F.col("ak") == F.col("bk")) & (F.col("ac") != F.col("bc")) & once & may_link("as", "bs", self.percent) & first)
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
        forget(signed)
        return self.verified(self.sharpened(pairs))

    def labelled(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, f1, f2, comp), one row per row of the input; comp is null for an empty set."""
        self.group()
        self.lists()
        first = self.star()
        further = self.rest(first)
        links = stored(first.union(further), "links")
        forget(first, further)
        label = components(links).withColumnRenamed("node", "_node")
        named = self.nodes.select("f1", "f2", "node", "least").join(label, F.col("node") == F.col("_node"), "left")
        named = stored(named.select("f1", "f2", "least", F.coalesce("component", "node").alias("comp")), "named")
        least = stored(named.groupBy(F.col("comp").alias("_comp")).agg(F.min("least").alias("component_id")), "least")
        final = stored(named.join(least, F.col("comp") == F.col("_comp")).select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "component_id", "comp"), "classes")
        rows = self.sets.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
        columns = ["doc_id", "n_shingles", "component_id", "f1", "f2", "comp"]
        some = rows.where("n_shingles > 0").join(final, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))).select(*columns)
        none = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "comp": F.lit(None).cast("long")})
        return some.union(none.select(*columns))

    def classes(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), one row per row of the input."""
        return self.labelled().select("doc_id", "n_shingles", "component_id")


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    return Join(docs, doc_id, text, percent).classes()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component, of the smallest id that is not null; a row is told by its id and set, not by the id alone.

    A row with an empty set is a component of its own; of those with equal id and text one stays, with a null id all.
    """
    rows = stored(Join(docs, doc_id, text, percent).labelled().select("doc_id", "component_id", "f1", "f2", "comp"), "labelled")
    vague = stored(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "vague")
    alone = rows.where("doc_id IS NOT NULL").join(vague, F.col("doc_id") == F.col("_id"), "left_anti")
    gone = stored(alone.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)), "copies")
    small = gone.limit(2_000_001).count() <= 2_000_000
    kept = docs.join(F.broadcast(gone) if small else gone, doc_id, "left_anti")
    if vague.isEmpty():
        return kept
    # Rows whose id is null or not the only one: by id and set.
    is_vague = docs[doc_id].eqNullSafe(F.col("_id"))
    own = stored(docs.join(vague, is_vague, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "vague")
    sets = described(own, "_row", text, percent, frequent_shingles(own, text)).select(F.col("doc_id").alias("_of"), "n", "f1", "f2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "f1", "f2")).alias("x")
    first = stored(rows.where("comp IS NOT NULL").groupBy("comp").agg(first).select(F.col("x.id").alias("_i"), F.col("x.f1").alias("_f1"), F.col("x.f2").alias("_f2")), "first")
    held = own.select("_row", F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text")).join(sets, F.col("_row") == F.col("_of"))
    held = stored(held.select("_row", "_id", "_text", "n", "f1", "f2"), "held")
    some = held.where("n > 0").join(first, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left_semi")
    some = some.groupBy("_id", "f1", "f2").agg(F.min("_row").alias("_stay")).select("_stay")
    empty = held.where("n = 0 AND _id IS NOT NULL").groupBy("_id", "_text").agg(F.min("_row").alias("_stay")).select("_stay")
    stay = stored(some.union(empty).union(held.where("n = 0 AND _id IS NULL").select("_row")), "stay")
    again = own.join(stay, F.col("_row") == F.col("_stay"), "left_semi").select(*docs.columns)
    return kept.join(vague, kept[doc_id].eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns).unionByName(again)


def op8_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))

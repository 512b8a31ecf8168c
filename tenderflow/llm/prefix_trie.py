"""Prefix trie of conversations, screened by a count-min sketch of prefix digests.

Each turn has a digest of its place, role and text; a prefix's digest is the sum of its turns' digests, so all prefixes follow from
running sums, and a conversation as long as the table is cut over many ranges like any other. Two sums of 64 bits, from
MD5, stand for a prefix; texts do not travel.

A count-min sketch counts all prefix digests. Its estimates are never too low, so an estimate of one proves that no other conversation has the
prefix: such nodes, the tails, are emitted where they are, with all their facts. Only the other prefixes are shuffled, grouped exactly and
counted. The sketch has a width that follows from the number of prefixes up to `MOST_CELLS`; beyond that estimates get higher and more
prefixes are shuffled, with the same result.

Sums over subtrees need no walk through the levels: a node's own value is given to its smallest member, at the node's depth. A
member's values from some depth on, by running sums from the end of the conversation, summed over all members of a node, are
then the sum over its subtree.

Nulls: a null turn comes first; a null role or text is an empty one. Rows without conv_id take no part. Turns with equal number follow
role, then a digest of the text; repeated rows are turns of their own. A conversation whose base is absent loses its first turns and can be
left without any: it is a member of the root alone. Only the four named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import segment_sums, stored, table, with_lookup

#: Conversations of a block share the first turns of its first one: their number is a checksum modulo HEADS.
BLOCK, HEADS = 100, 6
#: Rows of the sketch, cells for each prefix, and cells of a row at most (a bit each is sent to the executors).
SKETCH_ROWS, CELLS_EACH, MOST_CELLS = 2, 8, 1 << 27
#: Cells that travel together when parts of the sketch are added up.
CELL_BLOCK = 1 << 16
#: Members of a node in one piece of text on the way to its digest.
PIECE = 4096
NONE = hashlib.sha256(b"").hexdigest()
MIX = np.uint64(0x9E3779B97F4A7C15)


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, x, y, len): the text gives way to two halves of a digest and its length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda a: F.conv(F.substring(both, a, 15), 16, 10).cast("long")  # noqa: E731  60 bits each
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        half(1).alias("x"), half(17).alias("y"), F.char_length(text).cast("long").alias("len"),
    )


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, n, x, y, len): the turns of the rebuilt conversations, and their textless start at depth 0."""
    own = stored(turn_digests(turns).withColumn("one", F.lit(1)), "turns")
    placed = segment_sums(own, ["conv"], ["turn", "role", "x", "y"], {"place": "one"}, "places").drop("one", "turn", "role")
    placed = stored(placed, "placed")
    convs = placed.groupBy("conv").agg(F.count("*").alias("own")).withColumns(
        {"base": F.col("conv") - F.col("conv") % BLOCK, "head": head_length(F.col("conv"))}
    )
    convs = stored(convs, "convs")
    bases = convs.where(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("base"), "own").withColumnRenamed("own", "base_n")
    convs = with_lookup(convs, stored(bases, "bases"), ["base"]).withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = convs.select("conv", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n"))
    convs = stored(convs, "convs")
    heads = placed.where((F.col("conv") % BLOCK == 0) & (F.col("place") < HEADS)).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "x", "y", "len")
    borrowed = convs.where("taken > 0").select("conv", "n", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("depth"))
    borrowed = with_lookup(borrowed, stored(heads, "heads"), ["base", "depth"]).select("conv", "depth", "n", "x", "y", "len")
    rest = with_lookup(placed, stored(convs.select("conv", "head", "taken", "n"), "facts"), ["conv"]).where(F.col("place") > F.col("head"))
    rest = rest.select("conv", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "n", "x", "y", "len")
    zero = F.lit(0).cast("long")
    return rest.unionByName(borrowed).unionByName(convs.select("conv", zero.alias("depth"), "n", zero.alias("x"), zero.alias("y"), zero.alias("len")))


def mixed(c: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit numbers from 64-bit numbers."""
    z = (c.astype(np.uint64) + np.uint64(salt)) * MIX
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def with_values(rows: DataFrame) -> DataFrame:
    """Add v, w: the turn's digest together with its place, which prefixes sum up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth = mixed(numbers(b, "depth"), 1)
            used = (numbers(b, "depth") > 0).astype(np.uint64)
            with np.errstate(over="ignore"):
                v = mixed(numbers(b, "x").astype(np.uint64) + depth, 2) * used
                w = mixed(numbers(b, "y").astype(np.uint64) + depth, 3) * used
            columns = [b.column(c) for c in ("conv", "depth", "n", "len")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(v.view(np.int64)), pa.array(w.view(np.int64))], ["conv", "depth", "n", "len", "v", "w"])

    return rows.mapInArrow(run, "conv long, depth long, n long, len long, v long, w long")


def cells(p: np.ndarray, q: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(p.astype(np.uint64) + mixed(q, 11 + row), 17 + row) % np.uint64(width)).astype(np.int64)


def prefix_sketch(prefixes: DataFrame, width: int, rows: int = SKETCH_ROWS) -> DataFrame:
    """(row, block, shared): a bit for each cell that counts two prefixes or more.

    Every task counts on its own, up to 2 in a cell; its blocks of cells are then added up block by block.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emitted() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            row, cell = at // width, at % width
            group = row * (width // CELL_BLOCK + 1) + cell // CELL_BLOCK
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                counts = np.zeros(CELL_BLOCK, np.uint8)
                counts[cell[a:b] % CELL_BLOCK] = np.minimum(n[a:b], 2)
                yield pa.RecordBatch.from_pydict(
                    {"row": pa.array([int(row[a])], pa.int32()), "block": pa.array([int(cell[a] // CELL_BLOCK)], pa.int32()), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())}
                )

        for b in batches:
            p, q = numbers(b, "p"), numbers(b, "q")
            for r in range(rows):
                held.append(cells(p, q, r, width) + r * width)
                size += len(p)
            if size > 4_000_000:
                yield from emitted()
                held, size = [], 0
        if size:
            yield from emitted()

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts of one block after the other: as much memory as one block."""
        now, total = None, None
        out: list[tuple[int, int, bytes]] = []
        for pdf in parts:
            for row, block, counts in pdf.itertuples(index=False):
                if (row, block) != now:
                    if now is not None:
                        out.append((*now, np.packbits(total > 1, bitorder="little").tobytes()))
                    now, total = (row, block), np.zeros(CELL_BLOCK, np.uint8)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), 2).astype(np.uint8)
            if len(out) >= 64:
                yield pd.DataFrame(out, columns=["row", "block", "shared"])
                out = []
        if now is not None:
            out.append((*now, np.packbits(total > 1, bitorder="little").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["row", "block", "shared"])

    parts = prefixes.select("p", "q").mapInArrow(count, "row int, block int, counts binary")
    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInPandas(add, "row int, block int, shared binary")


class Screen:
    """Tells which prefixes are proven to be of one conversation only."""

    def __init__(self, sketch: list, width: int, rows: int = SKETCH_ROWS):
        self.width = width
        step = CELL_BLOCK // 8
        self.shared = np.zeros((rows, (width // CELL_BLOCK + 1) * step), np.uint8)
        for row, block, bits in sketch:
            self.shared[row, block * step : (block + 1) * step] = np.frombuffer(bits, np.uint8)

    def single(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), bool)
        for r in range(len(self.shared)):
            at = cells(p, q, r, self.width)
            out |= (self.shared[r][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        return out


def screened(prefixes: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(conv, depth, n, len, p, q, up_p, up_q, single, up_single): the prefixes with their parents' digests, both screened."""
    spark = prefixes.sparkSession
    width = 1 << 10
    wanted = CELLS_EACH * prefixes.count()
    while width < min(wanted, most_cells):
        width <<= 1
    # A quarter of most_cells bytes at most: a bit for each cell of two rows.
    screen = Screen([tuple(r) for r in prefix_sketch(prefixes, width).collect()], width)
    shared = spark.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q, v, w, depth = (numbers(b, c) for c in ("p", "q", "v", "w", "depth"))
            with np.errstate(over="ignore"):
                up_p, up_q = p - v, q - w
            single, up_single = shared.value.single(p, q), shared.value.single(up_p, up_q) & (depth > 0)
            columns = [b.column(c) for c in ("conv", "depth", "n", "len", "p", "q")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(up_p), pa.array(up_q), pa.array(single), pa.array(up_single)], ["conv", "depth", "n", "len", "p", "q", "up_p", "up_q", "single", "up_single"]
            )

    return prefixes.mapInArrow(run, "conv long, depth long, n long, len long, p long, q long, up_p long, up_q long, single boolean, up_single boolean")


def member_digests(ends: DataFrame) -> DataFrame:
    """(p, q, depth, ends_sha256): digest of the ascending members (p, q, depth, conv) of each node, comma-joined.

    A digest is made from the start to the end, so the members of one node are read by one task; they come to it as joined pieces, which
    are made in ranges beforehand, and pass through it one by one.
    """
    keys = ["p", "q", "depth"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                changed = (pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum()
                within = pdf.groupby(changed).cumcount() // PIECE
                yield pdf.groupby([changed, within], sort=False).agg(
                    p=("p", "first"), q=("q", "first"), depth=("depth", "first"), first=("conv", "first"), text=("conv", lambda c: ",".join(map(str, c)))
                )

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, None
        for pdf in batches:
            out = []
            for p, q, depth, text in pdf[[*keys, "text"]].itertuples(index=False):
                if (p, q, depth) == now:
                    made.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, made.hexdigest()))
                now, made = (p, q, depth), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, made.hexdigest())], columns=[*keys, "ends_sha256"])

    sorted_ends = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    joined = sorted_ends.mapInPandas(pieces, "p long, q long, depth long, first long, text string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(digests, "p long, q long, depth long, ends_sha256 string")


def trie(turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key, up = ["p", "q", "depth"], ["up_p", "up_q"]
    values = with_values(rebuilt(turns))
    prefixes = stored(segment_sums(values, ["conv"], ["depth"], {"p": "v", "q": "w"}, "prefixes"), "prefixes")
    rows = stored(screened(prefixes, most_cells), "screened")
    open_rows = rows.where("NOT single")
    tails = rows.where("single")

    # Exact nodes: all that may have several members.
    grouped = open_rows.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("len").alias("len"), F.first("up_p").alias("up_p"), F.first("up_q").alias("up_q"),
        F.first("up_single").alias("up_single"), F.sum((F.col("n") == F.col("depth")).cast("long")).alias("n_ends"),
    )
    nodes = stored(grouped, "nodes")
    below = tails.select(*up, "depth", "up_single").unionByName(nodes.select(*up, "depth", "up_single"))
    children = below.where("depth > 0 AND NOT up_single").groupBy(F.col("up_p").alias("p"), F.col("up_q").alias("q"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(with_lookup(nodes, stored(children, "children"), key).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # Values of nodes at their smallest member, summed from the end of each member and then over the members of a node.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    given = nodes.select(
        F.col("conv_id").alias("conv"), "depth", none.alias("p"), none.alias("q"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), F.lit(0).alias("asks"),
    ).where("saved > 0 OR leaf > 0")
    ended = tails.where("n = depth").select("conv", "depth", none.alias("p"), none.alias("q"), zero.alias("saved"), F.lit(1).cast("long").alias("leaf"), F.lit(0).alias("asks"))
    # The leaves of a tail below an open prefix; a member asks at each depth for what comes from there on.
    asking = open_rows.select("conv", "depth", "p", "q", zero.alias("saved"), zero.alias("leaf"), F.lit(1).alias("asks"))
    order = [F.desc("depth"), F.col("asks")]
    summed = segment_sums(given.unionByName(ended).unionByName(asking), ["conv"], order, {"sum_saved": "saved", "sum_leaves": "leaf"}, "subtrees")
    totals = summed.where("asks = 1").groupBy(*key).agg(F.sum("sum_saved").alias("saved_tokens"), F.sum("sum_leaves").alias("n_leaves"))
    nodes = with_lookup(nodes, stored(totals, "totals"), key)
    digests = member_digests(open_rows.where("n = depth"))
    nodes = stored(with_lookup(nodes, stored(digests, "digests"), key), "nodes")

    parents = stored(nodes.select(F.col("p").alias("up_p"), F.col("q").alias("up_q"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent")), "parents")
    # The parent of a node in a tail is in the tail as well, or an exact node.
    parent = F.when(F.col("depth") == 0, none).otherwise(F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    exact = with_lookup(nodes, parents, [*up, "depth"]).select(
        "conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )
    last = F.col("n") == F.col("depth")
    local = tails.withColumn("conv_id", F.col("conv")).withColumns(
        {
            "n_convs": F.lit(1).cast("long"), "n_children": (~last).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero,
            "ends_sha256": F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NONE)),
        }
    )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = local.where("up_single OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv")))
    first = with_lookup(local.where("NOT up_single AND depth > 0"), parents, [*up, "depth"]).withColumn("parent_conv_id", F.col("parent"))
    return exact.select(*names).unionByName(inside.select(*names)).unionByName(first.select(*names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))

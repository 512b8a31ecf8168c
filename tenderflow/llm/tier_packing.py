"""Hierarchical multi-length packing: context tiers, gaps of long windows filled from shorter tiers, balanced step groups.

A document is its ids and an end id. It is cut into full windows of the longest tier as long as it reaches; what remains is routed to
the shortest tier that holds it. Per tier, longest first, a piece opens a window of its own tier, and the gap behind
it is filled with the longest pieces of shorter tiers that fit; what is left of the gap takes the head of a longer piece, whose rest
is routed anew. Windows that end up full are sequences. What is left at the end, less than one window, is cut into powers of two,
which need no padding.
So no sequence is padded, and few documents are cut.

A block of documents (`BLOCK_TOKENS` ids, or one longer document) is packed on its own, so the work needs no shuffle, memory is
bounded by a block or the longest document, and a retry of a lost task gives the same sequences. `step_group` deals the sequences
of a tier to so many groups, the costly ones of a block (sum of squared piece lengths, the cost of attention) first, in snake order.
A block goes on where the one before it ended, and every partition starts at another group, so groups have equal costs over the
table, also where partitions are small.

Nulls: a null text is empty, and an empty document is its end id alone. A null id stays null. Repeated rows are packed one by one.
Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tenderflow.llm.common import table
from tenderflow.llm.tokens import encoder, in_batches

TIERS = (256, 512, 1024, 2048)
STEP_GROUPS = 8
END = 1
BLOCK_TOKENS = 1_000_000


class Shelf:
    """Pieces by length, the latest of a length first out."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.by_length: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, piece: tuple[int, int]) -> None:
        own = self.by_length.get(length)
        if own is None:
            own = self.by_length[length] = []
            bisect.insort(self.lengths, length)
        own.append(piece)

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most so many ids: document, start, length."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        length = self.lengths[at]
        own = self.by_length[length]
        doc, start = own.pop()
        if not own:
            del self.by_length[length]
            self.lengths.pop(at)
        return doc, start, length


def pack(sizes: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). Each is as long as a tier, or a power of two."""
    longest = tiers[-1]
    shelves = {t: Shelf() for t in tiers}
    done: list[list[tuple[int, int, int]]] = []

    def route(doc: int, start: int, length: int) -> None:
        shelves[tiers[bisect.bisect_left(tiers, length)]].put(length, (doc, start))

    for doc, size in enumerate(sizes.tolist()):
        start = 0
        while size - start >= longest:
            done.append([(doc, start, longest)])
            start += longest
        if size > start:
            route(doc, start, size - start)

    rest: list[tuple[int, int, int]] = []
    for own in reversed(tiers):
        while True:
            piece = shelves[own].take(own)
            if piece is None:
                break
            window, gap = [piece], own - piece[2]
            while gap:
                fit = None
                for t in reversed(tiers):  # longer tiers are empty by now
                    fit = shelves[t].take(gap)
                    if fit:
                        break
                if fit is None:
                    longer = next((x for t in tiers if (x := shelves[t].take(longest))), None)
                    if longer is None:
                        break
                    doc, start, length = longer
                    fit = (doc, start, gap)
                    route(doc, start + gap, length - gap)
                window.append(fit)
                gap -= fit[2]
            if gap:
                rest = window
            else:
                done.append(window)
    # The last window that nothing was left for: powers of two, largest first.
    total = sum(x[2] for x in rest)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            doc, start, length = rest[0]
            n = min(room, length)
            part.append((doc, start, n))
            rest[0] = (doc, start + n, length - n)
            if n == length:
                rest.pop(0)
            room -= n
        done.append(part)
    return done


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, "
    "context int, step_group int"
)


def pack_documents(
    docs: DataFrame, tokenizer: str, kind: str = "word", end: int = END, tiers: tuple[int, ...] = TIERS, doc_id: str = "doc_id",
    text: str = "text", step_groups: int = STEP_GROUPS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a sequence; with_ids adds the ids themselves. sequence_id is unique over the table."""
    tiers = tuple(sorted(tiers))

    def block(ids: np.ndarray, sizes: np.ndarray, keys: list, first_id: int, dealt: list[int], first_group: int) -> tuple[pa.RecordBatch, int]:
        base = np.cumsum(sizes) - sizes
        sequences = pack(sizes, tiers)
        cost = np.array([sum(p[2] * p[2] for p in s) for s in sequences])
        totals = [sum(p[2] for p in s) for s in sequences]
        tier = np.minimum(np.searchsorted(tiers, totals), len(tiers) - 1)
        group = np.empty(len(sequences), np.int64)
        for t in range(len(tiers)):
            own = np.flatnonzero(tier == t)
            turn = (dealt[t] + np.arange(len(own))) % (2 * step_groups)
            group[own[np.argsort(-cost[own], kind="stable")]] = (np.minimum(turn, 2 * step_groups - 1 - turn) + first_group) % step_groups
            dealt[t] += len(own)
        rows = []
        pieces = []
        for n, s in enumerate(sequences):
            total, offset, context = totals[n], 0, tiers[tier[n]]
            for doc, start, length in s:
                own = ids[base[doc] + start : base[doc] + start + length]
                pieces.append(own)
                rows.append((keys[doc], start, length, zlib.crc32(own.astype("<u4").tobytes()), int(sizes[doc]), first_id + n, offset, total, context, int(group[n])))
                offset += length
        columns = [pa.array(x, pa.int32() if i >= 8 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_ids:
            at = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(pieces).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), first_id + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer, kind, end)
        partition = TaskContext.get().partitionId()
        next_id = partition << 36
        dealt = [0] * len(tiers)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        n = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for part in in_batches(batch.column(1)):
                ids, sizes = own_encoder.encode(part.texts, end)
                held.append((ids, sizes, keys[part.first : part.first + len(part.texts)]))
                n += len(ids)
                if n >= BLOCK_TOKENS:
                    out, next_id = block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [k for h in held for k in h[2]], next_id, dealt, partition)
                    held, n = [], 0
                    yield out
        if held:
            out, next_id = block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [k for h in held for k in h[2]], next_id, dealt, partition)
            yield out

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op6_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

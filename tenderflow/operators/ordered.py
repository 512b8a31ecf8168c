"""Ordered passes over the rows of a key, where a key may hold any share of the rows.

Rows are range partitioned by key and order, so a key that is too large for one range fills several. What a range does to a state is a function of
the state it begins with. Ranges tell this function in a short form; the functions of a key are applied one after the other to its first
state, which gives the state each range begins with; then all ranges run at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.session import cut_lineage

NEVER, ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Growth:
    """A record that a row replaces when it is larger by over `more` or newer; replacing stamps it with `now`.

    Sizes and times of some rows in order. `after[i]` is the next row that replaces row i once that is in place, and `last[i]` the one that
    stays at the end, so the whole range is known for any first state as soon as its first replacement is.
    """

    def __init__(self, size: np.ndarray, at: np.ndarray, more: int, now: int):
        self.size, self.at, self.more, self.now = size, at, more, now

    def first(self, size: int, at: int) -> int:
        """The first row that replaces the record, or the number of rows."""
        hits = np.flatnonzero((self.size > size + self.more) | (self.at > at))
        return int(hits[0]) if len(hits) else len(self.size)

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        """(after, last), from the end to the beginning.

        The rows that can be next are kept on a stack, larger ones behind smaller ones; a newer row is next whatever its size.
        """
        n = len(self.size)
        after, last = np.full(n, n), np.arange(n)
        places: list[int] = []
        negative: list[int] = []  # sizes with a minus, falling towards the end of the stack: ascending negatives
        newer = n
        for i in range(n - 1, -1, -1):
            at = bisect_left(negative, -(int(self.size[i]) + self.more))
            larger = places[at - 1] if at else n
            after[i] = min(larger, newer)
            if after[i] < n:
                last[i] = last[after[i]]
            while negative and -negative[-1] <= self.size[i]:
                negative.pop()
                places.pop()
            negative.append(-int(self.size[i]))
            places.append(i)
            if self.at[i] > self.now:
                newer = i
        return after, last

    def replaced(self, size: int, at: int) -> tuple[np.ndarray, int, int]:
        """Rows that replace the record when all come in order, and the record's size and time in the end."""
        i = self.first(size, at)
        out = []
        for j, (s, t) in enumerate(zip(self.size[i:].tolist(), self.at[i:].tolist(), strict=True), i):
            if s > size + self.more or t > at:
                out.append(j)
                size, at = s, self.now
        return np.array(out, np.int64), size, at

    def outcome(self) -> list[tuple[int, int, int]]:
        """(size from, time from, size in the end) of the rows that can be the first to replace a record, in order.

        Only rows larger or newer than all before them can. A record below one of the two is replaced by the row.
        """
        _, last = self.chain() if len(self.size) else (None, np.zeros(0, np.int64))
        size = np.concatenate([[NEVER], np.maximum.accumulate(self.size)[:-1]]) if len(self.size) else self.size
        at = np.concatenate([[NEVER], np.maximum.accumulate(self.at)[:-1]]) if len(self.size) else self.at
        rows = np.flatnonzero((self.size > size) | (self.at > at))
        return [(int(self.size[i]) - self.more, int(self.at[i]), int(self.size[last[i]])) for i in rows]


def replacing_rows(rows: DataFrame, more: int, now: int) -> DataFrame:
    """Ids of the rows that replace their target's record when all are applied in id order.

    `rows(id, target, own_size, own_at, size, at)`: `size` and `at` are the target's at first, equal on all its rows; times in microseconds. A target's
    chain may be of any length, and no round of it costs a job.
    """
    ordered = cut_lineage(rows.repartitionByRange("target", "id").sortWithinPartitions("target", "id"))

    def whole_targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a range in lots that hold all rows of their targets there."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            target = pdf["target"].to_numpy()
            if held and held[-1]["target"].iloc[-1] == target[0] == target[-1]:
                held.append(pdf)
                continue
            new = int(np.flatnonzero(target == target[-1])[0])  # the last target may go on in the next batch
            if new:
                yield pd.concat([*held, pdf.iloc[:new]]) if held else pdf.iloc[:new]
                held = [pdf.iloc[new:]]
            else:
                if held:
                    yield pd.concat(held)
                held = [pdf]
        if held:
            yield pd.concat(held)

    def growth(part: pd.DataFrame) -> Growth:
        return Growth(part["own_size"].to_numpy(), part["own_at"].to_numpy(), more, now)

    def replacing(lot: pd.DataFrame, begin: tuple[str, int, int] | None) -> np.ndarray:
        """Places in the lot of the rows that replace their target's record; `begin` is the state of the first target, if it is not the given one."""
        target, own_size, own_at = (lot[c].to_numpy() for c in ("target", "own_size", "own_at"))
        new = np.append(True, target[1:] != target[:-1])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        size, at = lot["size"].to_numpy()[start], lot["at"].to_numpy()[start]
        if begin and begin[0] == target[0]:
            size, at = size.copy(), at.copy()
            size[0], at[0] = begin[1:]
        hit = (own_size > size[group] + more) | (own_at > at[group])
        end = np.append(start[1:], len(lot))
        kept = hit & (end - start == 1)[group]
        # Targets of several rows of which one replaces the record at first.
        for g in np.unique(group[hit & ~kept]):
            rows = slice(start[g], end[g])
            one = Growth(own_size[rows], own_at[rows], more, now)
            kept[start[g] + one.replaced(int(size[g]), int(at[g]))[0]] = True
        return np.flatnonzero(kept)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the first and the last target of a range do to the record; targets between them have no other range.

        kind 0: the record a target begins with, 1: a row of `outcome`, 2: the state after a range that the target begins in.
        """
        own = TaskContext.get().partitionId()
        columns = ["target", "range", "kind", "place", "size", "at", "result"]
        first, part = True, None
        for lot in whole_targets(batches):
            if first:
                part = lot[lot["target"] == lot["target"].iloc[0]]
                target, size, at = part["target"].iloc[0], int(part["size"].iloc[0]), int(part["at"].iloc[0])
                rows = [(target, own, 0, 0, size, at, 0)]
                rows += [(target, own, 1, i + 1, s, t, r) for i, (s, t, r) in enumerate(growth(part).outcome())]
                yield pd.DataFrame(rows, columns=columns)
                first = False
            part = lot[lot["target"] == lot["target"].iloc[-1]]
        if part is not None and part["target"].iloc[0] != target:
            _, size, at = growth(part).replaced(int(part["size"].iloc[0]), int(part["at"].iloc[0]))
            yield pd.DataFrame([(part["target"].iloc[0], own, 2, 0, size, at, 0)], columns=columns)

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(range, target, size, at): the state of a target at the beginning of each range that starts with it."""
        now_target, size, at, number, open_ = None, 0, 0, None, False
        for pdf in batches:
            out = []
            for target, own, kind, _, s, t, result in pdf.itertuples(index=False):
                if target != now_target:
                    now_target, number = target, None
                    if kind != 2:
                        size, at = s, t
                if kind == 2:
                    size, at, number = s, t, own
                elif own != number:
                    number, open_ = own, True
                    out.append((own, target, size, at))
                if kind == 1 and open_ and (s > size or t > at):
                    size, at, open_ = result, now, False
            yield pd.DataFrame(out, columns=["range", "target", "size", "at"])

    told = ordered.mapInPandas(ends, "target string, range int, kind int, place long, size long, at long, result long")
    # A few rows for each range: of a target that fills many, they pass through one task, one by one.
    states = told.repartition("target").sortWithinPartitions("target", "range", "kind", "place").mapInPandas(begins, "range int, target string, size long, at long")
    first = {r["range"]: (r["target"], r["size"], r["at"]) for r in states.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = shared.value.get(TaskContext.get().partitionId())
        for lot in whole_targets(batches):
            kept = replacing(lot, begin)
            if len(kept):
                yield lot[["id"]].iloc[kept]

    return ordered.mapInPandas(applied, "id long")


def micros(c: Column) -> Column:
    """Microseconds of a timestamp, whatever its kind."""
    return F.unix_micros(c.cast("timestamp"))

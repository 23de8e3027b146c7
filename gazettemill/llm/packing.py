"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents are encoded once, cut at the capacity, and only the histogram of
piece lengths (at most ``capacity`` rows, whatever the corpus size) reaches
the driver. There the reduction fixes sets that provably dominate every
alternative (an exact complement; the largest partner where no two others
fit; a pair where no better pair fits), each with its whole multiplicity, and
best fit packs the remainder. The result is a list of patterns with
multiplicities; executors give each piece its place by its rank among the
pieces of its length.

Null text counts as empty: the piece is the end id alone. Every row is a
document of its own, also where doc_id is null or repeated. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

Pattern = tuple[tuple[int, ...], int]
_PIECES = "doc_id long, piece int, start long, length long, ids binary, task long, nth long"


class _Sizes:
    """Item counts by size with the sizes kept in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = Counter({s: c for s, c in counts.items() if c})
        self.keys = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.keys.pop(bisect_left(self.keys, size))

    def below(self, limit: int, without: Counter) -> int | None:
        """Largest size up to ``limit`` that is left when ``without`` is taken out."""
        i = bisect_right(self.keys, limit)
        while i:
            i -= 1
            if self.n[self.keys[i]] > without[self.keys[i]]:
                return self.keys[i]
        return None

    def smallest(self, count: int, without: Counter) -> list[int]:
        out: list[int] = []
        for s in self.keys:
            out += [s] * min(self.n[s] - without[s], count - len(out))
            if len(out) == count:
                break
        return out

    def best_pair(self, limit: int, without: Counter) -> tuple[int, int] | None:
        """The pair of largest sum up to ``limit``; of equal sums the one with the largest item."""
        best, lo, hi = None, 0, bisect_right(self.keys, limit) - 1
        left = lambda s: self.n[s] - without[s]
        while lo <= hi:
            a, b = self.keys[hi], self.keys[lo]
            if a + b > limit or not left(a):
                hi -= 1
            elif not left(b) or (a == b and left(a) < 2):
                lo += 1
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                lo += 1
        return best

    def fix(self, pattern: tuple[int, ...]) -> Pattern:
        """Take ``pattern`` out as often as the counts allow."""
        need = Counter(pattern)
        times = min(self.n[s] // k for s, k in need.items())
        for s, k in need.items():
            self.take(s, k * times)
        return pattern, times


def reduce_by_dominance(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Fix sets that dominate all others holding their largest item, until none is left to fix."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(sizes.keys, reverse=True):
            while sizes.n[w]:
                own, room = Counter([w]), capacity - w
                small = sizes.smallest(3, own)
                fit = sum(sum(small[: i + 1]) <= room for i in range(len(small)))
                partner = sizes.below(room, own)
                found: tuple[int, ...] | None = None
                if fit == 0:
                    found = (w,)
                elif fit == 1 or partner == room:
                    found = (w, partner)
                elif fit == 2:
                    a, b = sizes.best_pair(room, own)
                    if partner >= a + b:
                        found = (w, partner)
                    elif a == partner and (c := sizes.below(room // 2, own)) is not None and b >= c:
                        found = (w, a, b)  # no pair that fits has a larger lesser item
                if not found:
                    break
                fixed.append(sizes.fix(found))
                changed = True
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Best fit on the counts: the largest item, then whichever single item or pair leaves least room."""
    out: list[Pattern] = []
    while sizes.keys:
        chosen = [sizes.keys[-1]]
        room = capacity - chosen[0]
        while room > 0:
            own = Counter(chosen)
            one, two = sizes.below(room, own), sizes.best_pair(room, own)
            if one is None:
                break
            more = list(two) if two and sum(two) > one else [one]
            chosen += more
            room -= sum(more)
        out.append(sizes.fix(tuple(chosen)))
    return out


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Classic best-fit decreasing on the counts; bins of equal content move together."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                held = capacity // size
                full, rest = divmod(left, held)
                fresh = [((size,) * held, full)] * (full > 0) + [((size,) * rest, 1)] * (rest > 0)
                left = 0
            else:
                room = rooms[i]
                group = open_bins[room]
                content, times = group.pop()
                if not group:
                    del open_bins[room]
                    rooms.pop(i)
                moved = min(times, left)
                left -= moved
                fresh = [((*content, size), moved)] + [(content, times - moved)] * (times > moved)
            for content, times in fresh:
                room = capacity - sum(content)
                if room not in open_bins:
                    rooms.insert(bisect_left(rooms, room), room)
                    open_bins[room] = []
                open_bins[room].append([content, times])
    return [(content, times) for group in open_bins.values() for content, times in group]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns with multiplicities that hold all items: reduction, then the better of two best fits."""
    sizes = _Sizes(counts)
    fixed = reduce_by_dominance(sizes, capacity)
    rest = dict(sizes.n)
    decreasing = best_fit_decreasing(rest, capacity)
    filled = best_fit(sizes, capacity)
    return fixed + min(decreasing, filled, key=lambda ps: sum(m for _, m in ps))


@dataclass(frozen=True)
class PackedCorpus:
    """``pieces`` hold the ids; ``placed()`` adds sequence_id and offset to any columns of them."""

    pieces: DataFrame
    patterns: list[Pattern]
    capacity: int

    def placed(self, *columns) -> DataFrame:
        """The given columns (length is always there) of each piece with its place."""
        spark = self.pieces.sparkSession
        bases = self.pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        bases = bases.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        ranked = self.pieces.select(*columns, "length", "task", "nth").join(bases, ["task", "length"])
        ranked = ranked.withColumn("rank", F.col("base") + F.col("nth")).drop("task", "nth", "base")

        used: Counter = Counter()
        slots, sequence = [], 0
        for content, times in self.patterns:
            offset = 0
            for size in content:
                slots.append((size, used[size], sequence, offset))
                used[size] += times
                offset += size
            sequence += times
        table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
        shared = spark.sparkContext.broadcast((table[:, 0] * (1 << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, first, seq, off = shared.value
            for pdf in batches:
                rank = pdf["rank"].to_numpy()
                at = np.searchsorted(keys, pdf["length"].to_numpy() * (1 << 48) + rank, side="right") - 1
                yield pdf.drop(columns="rank").assign(sequence_id=seq[at] + rank - first[at], offset=off[at])

        schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
        return ranked.mapInPandas(place, schema)

    def sequences(self) -> DataFrame:
        """(sequence_id, ids): the packed sequences, at most ``capacity`` ids each."""
        parts = self.placed("ids").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> PackedCorpus:
    """Pack ``docs`` (doc_id, text); a longer document is cut, its first piece taking the remainder."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def cut_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, raw in zip(pdf["doc_id"].astype("Int64"), enc.encode(pdf["text"].tolist())):
                raw += end
                total, start, piece = len(raw) // 4, 0, 0
                stop = total % capacity or min(capacity, total)
                while start < total:
                    size = stop - start
                    rows.append((doc_id, piece, start, size, raw[4 * start : 4 * stop], task, seen[size]))
                    seen[size] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in _PIECES.split(", ")])
            yield out.astype({"doc_id": "Int64", "piece": "int32"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    pieces = common.cut(texts.mapInPandas(cut_pieces, _PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return PackedCorpus(pieces, pack_histogram(histogram, capacity), capacity)

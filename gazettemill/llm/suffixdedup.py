"""Repeated byte strings by suffix arrays of anchored contexts.

A string of ``length`` bytes that starts at two places shares an anchor
there: the smallest-hash ``ANCHOR``-gram of each window, which depends on the
window's content alone. So the corpus is dealt out by anchors, and only
contexts (the bytes within ``length`` of an anchor that occurs twice or more)
are compared, each different context of an anchor once. Contexts of an anchor
stand aligned at it, so two of them share a window where the bytes that agree
to the left and to the right add up to ``length``.

Contexts that can't share a window with any other drop out first. The others
are cut where any two of an anchor's contexts part, which makes each a short
row of integers, and one suffix array for thousands of contexts shows which
repeat. It is built by linear grouping: groups of suffixes are processed in
descending order, previous-smaller pointers tell which suffixes a group
extends, these become groups of their own above the rest of theirs until each
group shares a Lyndon prefix, and a last pass emits each group's order, with
no renaming and no recursion. Suffixes with equal left parts stand together,
next to those whose right parts agree longest.

An anchor with more than ``CROWD`` different contexts (the end of a passage
in a third of all documents, say) is no task's group: its contexts are dealt
out by ranges of ``SPLIT`` window offsets. Contexts that share a window there
have the bytes common to all these windows in common and differ in under
``SPLIT`` bytes at each end. Bytes that only one context has in common go
first; of the rest each different case is kept once, with its count, and its
windows are counted one by one in partial aggregates. That is as exact, and
loses nothing.

Whole contexts are held equal by two independent 64-bit hashes, of the anchor
and of all bytes; a range's common bytes by the anchor's and one of their own,
and the windows around them by two more; everything else by bytes. Null text
counts as empty. Matches never cross documents;
spans are judged on the input. A row is a document of its own, so repeated
rows repeat each other's strings. An empty table gives no rows. Other columns
pass through, but for those that carry the results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ANCHOR = 64
#: Different contexts of an anchor beyond which they are split by their windows' offsets, and offsets in a range of the split.
CROWD, SPLIT = 500, 16
#: Contexts that go into one suffix array, unless one anchor has more.
TOGETHER = 20_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_DOC, _BODY = "__gm_doc", "__gm_body"


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """Group (by its first place) of each suffix, by Lyndon prefix, and its pointer to the previous smaller group."""
    n = len(text)
    order = np.argsort(np.array(text, np.int64), kind="stable").tolist()
    place, group, size, previous = [0] * n, [0] * n, [0] * n, [-1] * n
    first = 0
    for at, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = at
        place[i] = at
        group[i] = first
        size[first] += 1
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:  # a group of one suffix
            i = order[g]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[i] = p
            if p >= 0 and (left := size[h := group[p]] - 1):
                at, hole = h + left, place[p]
                other = order[at]
                order[at], order[hole] = p, other
                place[p], place[other] = at, hole
                size[h] = left
                size[at] = 1
                group[p] = at
            end = g - 1
            continue
        members = order[g : end + 1]
        members.sort()
        reached: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p in reached:
                reached[p] += 1
            else:
                reached[p] = 1
        reached.pop(-1, None)
        # Suffixes that this group extends, most often first, move to the end of their groups.
        times = set(reached.values())
        for most in sorted(times, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in reached if len(times) == 1 else [p for p, k in reached.items() if k == most]:
                if (h := group[p]) in moved:
                    moved[h].append(p)
                else:
                    moved[h] = [p]
            for h, some in moved.items():
                left = size[h] - len(some)
                if not left:
                    continue
                at = h + size[h]
                for p in some:
                    at -= 1
                    other, hole = order[at], place[p]
                    order[at], order[hole] = p, other
                    place[p], place[other] = at, hole
                size[h] = left
                size[at] = len(some)
                for p in some:
                    group[p] = at
        end = g - 1
    return group, previous


def suffix_array(text: list[int]) -> list[int]:
    """All suffixes of ``text`` in order; its last symbol must be smaller than all others."""
    group, previous = lyndon_groups(text)
    n = len(text)
    free, out, placed = list(range(n)), [n - 1] * n, [False] * n
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    return out


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes for each start, read forwards or (step -1) backwards, filled up with zeros."""
    width = int(sizes.max(initial=1)) or 1
    reach = np.arange(width)
    at = np.clip(starts[:, None] + step * reach, 0, max(0, len(data) - 1))
    return np.where(reach < sizes[:, None], data[at] if len(data) else 0, 0).astype(np.uint8)


def _ordered(owner: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order by owner, then bytes, then size."""
    keys = np.concatenate([owner.astype(">u4").view(np.uint8).reshape(-1, 4), rows, sizes.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def _agreement(owner: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it; -1 where that has another owner."""
    out = np.full(len(rows), -1)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        n = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
        out[1:] = np.where(owner[1:] == owner[:-1], np.minimum(n, np.minimum(sizes[1:], sizes[:-1])), -1)
    return out


def _best(order: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Longest agreement of each row with any other of its owner, from those with its neighbours in order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(agree, np.append(agree[1:], -1))
    return out


def _nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller value before and after each place, for values of a small range."""
    n = len(values)
    before, after = np.full(n, -1), np.full(n, n)
    for v in np.unique(values):
        here = np.flatnonzero(values == v)
        smaller = np.flatnonzero(values < v)
        if len(smaller):
            k = np.searchsorted(smaller, here)
            before[here] = np.where(k > 0, smaller[k - 1], -1)
            after[here] = np.where(k < len(smaller), smaller[np.minimum(k, len(smaller) - 1)], n)
    return before, after


class _Cuts:
    """One side of the contexts, cut where rows part: (row, depth, symbol) of each class of rows that agree just so far."""

    def __init__(self, owner: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        order = _ordered(owner, rows, sizes)
        agree = np.append(_agreement(owner[order], rows[order], sizes[order]), -1)
        before, after = _nearest_smaller(agree)
        live = np.arange(len(order))
        low, high = live, live + 1  # the class is rows low to high - 1, at first the row alone
        found = []
        while len(live):
            depth = np.maximum(agree[low], agree[high])
            low, high = np.where(agree[low] == depth, before[low], low), np.where(agree[high] == depth, after[high], high)
            inside = depth > 0
            live, low, high = live[inside], low[inside], high[inside]
            found.append((order[live], depth[inside], low << 32 | high))
        self.row, self.depth, classes = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        self.symbol = np.unique(classes, return_inverse=True)[1]


def repeated_contexts(owner: np.ndarray, data: np.ndarray, starts: np.ndarray, left: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes to the left, bytes to the right of the middle) of each context's repeated windows; -1 where it has none.

    Contexts are data[starts:ends] with the middle ``left`` bytes in; those of
    an owner are all different.
    """
    middle = starts + left
    right = ends - middle
    before, after = _matrix(data, middle - 1, left, -1), _matrix(data, middle, right, 1)
    best = 0
    for rows, sizes in ((before, left), (after, right)):
        order = _ordered(owner, rows, sizes)
        agree = _best(order, _agreement(owner[order], rows[order], sizes[order]))
        best = best + np.where(agree < 0, -length, agree)
    kept = np.flatnonzero(best >= length)
    most_left, most_right = np.full(len(owner), -1), np.full(len(owner), -1)
    if not len(kept):
        return most_left, most_right
    owner = np.unique(owner[kept], return_inverse=True)[1]
    befores, afters = _Cuts(owner, before[kept], left[kept]), _Cuts(owner, after[kept], right[kept])

    # The integer text: each context's left classes from outside in, its owner, its right classes, and an end.
    m = len(kept)
    low = 2 + len(np.unique(owner))
    high = low + int(befores.symbol.max(initial=0)) + 1
    row = np.concatenate([befores.row, np.arange(m), afters.row, np.arange(m)])
    rank = np.concatenate([-befores.depth, np.zeros(m, np.int64), afters.depth, np.full(m, length * 4)])
    symbol = np.concatenate([befores.symbol + low, owner + 2, afters.symbol + high, np.ones(m, np.int64)])
    order = np.lexsort((rank, row))
    row, rank, symbol = row[order], rank[order], symbol[order]
    found = np.array(suffix_array([*symbol.tolist(), 0]))
    found = found[found < len(symbol)]
    found = found[rank[found] <= 0]  # suffixes that start at the middle or before it

    centre = np.flatnonzero(rank == 0)
    a, b = found[:-1], found[1:]
    together = symbol[a] == symbol[b]
    a, b = a[together], b[together]
    reach = np.zeros(len(a), np.int64)
    live, step = np.arange(len(a)), 1
    while len(live):
        x, y = centre[row[a[live]]] + step, centre[row[b[live]]] + step
        live = live[(symbol[x] == symbol[y]) & (symbol[x] >= high)]
        reach[live] = rank[centre[row[a[live]]] + step]
        step += 1
    for i in (a, b):
        good = reach - rank[i] >= length
        np.maximum.at(most_left, kept[row[i[good]]], -rank[i[good]])
        np.maximum.at(most_right, kept[row[i[good]]], reach[good])
    return most_left, most_right


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(n, base, _U))]) for base in (_BASE, inverse))


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, _U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Rolling:
    """Hashes of any substrings of one text from its prefix sums."""

    def __init__(self, data: bytes):
        self.n = len(data)
        self.powers, self.inverse = _powers(max(12, self.n.bit_length()))
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_byte_values()[np.frombuffer(data, np.uint8)] * self.powers[: self.n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))

    def grams(self, size: int) -> np.ndarray:
        m = self.n - size + 1
        return _mixed((self.sums[size:] - self.sums[:m]) * self.inverse[:m])


def _sliding(values: np.ndarray, width: int, ufunc, fill) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values."""
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = ufunc.accumulate(rows, axis=1).ravel()
    back = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(values) - width + 1
    return ufunc(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(roll: Rolling, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some window of ``length`` bytes."""
    grams = roll.grams(ANCHOR)
    width = length - ANCHOR + 1
    least = _sliding(grams, width, np.minimum, _U(0xFFFFFFFFFFFFFFFF))
    edge = np.zeros(width - 1, _U)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum, _U(0)) == grams)
    return chosen, grams[chosen]




def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({_DOC: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), _BODY: F.xxhash64(common.text_or_empty()), "text": common.text_or_empty()})


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text or binary column."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _cut_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all (start, end), one after the other, and their offsets."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)], at


def _as_binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, context, from, to) of the contexts that repeat in part; ``rows``: anchor, context, n, left, bytes."""
    names = ["anchor", "context"]
    dealt = rows.repartition(common.partitions(rows.sparkSession), "anchor").sortWithinPartitions(*names).select(*names, "n", "left", "bytes")

    def decide(ids: np.ndarray, n: np.ndarray, left: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]).any(axis=1)  # a repeated row of a document gives its contexts again
        ids, n, left, starts, ends = ids[fresh], n[fresh], left[fresh].astype(np.int64), at[:-1][fresh], at[1:][fresh]
        owner = np.zeros(len(ids), np.int64)
        owner[1:] = np.cumsum((ids[1:, :-1] != ids[:-1, :-1]).any(axis=1))
        before, after = repeated_contexts(owner, data, starts, left, ends, length)
        copied = (n > 1) & (ends - starts >= length)
        before, after = np.where(copied, left, before), np.where(copied, ends - starts - left, after)
        hit = before >= 0
        return pa.RecordBatch.from_arrays([*(pa.array(ids[hit, k]) for k in range(len(names))), pa.array(-before[hit], pa.int32()), pa.array(after[hit], pa.int32())], names=[*names, "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def joined() -> tuple:
            ids, n, left = (np.concatenate([h[k] for h in held]) for k in range(3))
            sizes = np.concatenate([np.diff(h[4]) for h in held])
            return ids, n, left, np.concatenate([h[3] for h in held]), np.concatenate([[0], np.cumsum(sizes)])

        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = _binary(batch.column(len(names) + 2))
            ids = np.stack([batch.column(k).to_numpy() for k in range(len(names))], axis=1)
            held.append((ids, batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy(), data[at[0] : at[-1]], at - at[0]))
            if sum(len(h[0]) for h in held) < TOGETHER:
                continue
            ids, n, left, data, at = joined()
            cut = len(ids) - int((ids[::-1, :-1] != ids[-1, :-1]).any(axis=1).argmax())
            if (ids[0, :-1] == ids[-1, :-1]).all():
                held = [(ids, n, left, data, at)]
                continue
            yield decide(ids[:cut], n[:cut], left[:cut], data, at[: cut + 1])
            held = [(ids[cut:], n[cut:], left[cut:], data[at[cut] :], at[cut:] - at[cut])]
        if held:
            yield decide(*joined())

    return dealt.mapInArrow(run, "anchor long, context long, from int, to int")


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc, body, start, end) of byte spans that repeat; they overlap. doc and body are the keys of ``_keyed``."""
    common.small_batches(docs.sparkSession)
    side = length - ANCHOR

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            data, at = _binary(batch.column(2))
            raw, parts = data.tobytes(), []
            for doc, body, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if b - a < length:
                    continue
                whole = raw[a:b]
                pos, hashes = anchors(Rolling(whole), length)
                starts, ends = np.maximum(pos - side, 0), np.minimum(pos + length, b - a)
                around = np.array([xxh3_64_intdigest(whole[x:y]) for x, y in zip(starts.tolist(), ends.tolist())], _U) + (pos - starts).astype(_U)
                parts.append((hashes.view(np.int64), around.view(np.int64), np.full(len(pos), doc), np.full(len(pos), body), pos.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["anchor", "context", "doc", "body", "pos"])

    texts = _keyed(docs).select(F.col(_DOC).alias("doc"), F.col(_BODY).alias("body"), "text")
    found = common.cut(texts.mapInArrow(find, "anchor long, context long, doc long, body long, pos int"), "anchors")
    often = common.cut(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"), "often")
    again = common.cut(common.weighted_join(found, often, ["anchor"], "times", "inner", common.meet).drop("times"), "again")

    classes = common.cut(again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "body", "pos")).alias("at")), "classes")
    several = common.cut(classes.groupBy("anchor").agg(F.count("*").alias("contexts")), "several")
    counted = common.cut(common.weighted_join(classes, several, ["anchor"], "contexts", "inner", common.meet), "counted")
    whole = counted.where("contexts = 1 and n > 1").select("anchor", "context", F.lit(-side).alias("from"), F.lit(length).alias("to"))
    split = counted.where("contexts > 1")
    wanted = split.groupBy(F.col("at.doc").alias("doc"), F.col("at.body").alias("body")).agg(F.collect_list(F.struct("anchor", "context", "n", "contexts", F.col("at.pos").alias("pos"))).alias("wanted"))
    held = common.meet(texts, common.cut(wanted, "wanted"), ["doc", "body"]).select("text", "wanted")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, at), asked = _binary(batch.column(0)), batch.column(1)
            flat = asked.flatten()
            anchor, context, n, contexts, pos = (flat.field(k) for k in range(5))
            of = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            here = at[of] + pos.to_numpy()
            starts, ends = np.maximum(here - side, at[of]), np.minimum(here + length, at[of + 1])
            for lo in range(0, len(flat), TOGETHER):
                some = slice(lo, lo + TOGETHER)
                m = len(here[some])
                yield pa.RecordBatch.from_arrays(
                    [x.slice(lo, m) for x in (anchor, context, n, contexts)] + [pa.array((here - starts)[some], pa.int32()), _as_binary(*_cut_bytes(data, starts[some], ends[some]))],
                    names=["anchor", "context", "n", "contexts", "left", "bytes"],
                )

    contexts = common.cut(held.mapInArrow(slices, "anchor long, context long, n long, contexts long, left int, bytes binary"), "contexts")
    spans = whole.union(_compared(contexts.where(F.col("contexts") <= CROWD), length))
    if (several.agg(F.max("contexts")).first()[0] or 0) > CROWD:
        spans = spans.union(_split(contexts.where(F.col("contexts") > CROWD), length))
    spans = common.cut(common.meet(spans, classes.select("anchor", "context", "n"), ["anchor", "context"]), "found")
    placed = common.weighted_join(again, spans, ["anchor", "context"], "n", "inner", common.meet)
    return placed.select("doc", "body", F.greatest(F.col("pos") + F.col("from"), F.lit(0)).alias("start"), (F.col("pos") + F.col("to")).alias("end"))


_DEALT = {"anchor": pa.int64(), "low": pa.int64(), "core": pa.int64(), "context": pa.int64(), "n": pa.int64(), "near": pa.binary(), "after": pa.binary()}


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, from, to) of crowded anchors: their contexts dealt out by what windows of near offsets share."""
    side = length - ANCHOR

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cases of windows that start ``low`` to ``high`` bytes before the anchor: common bytes by hash, and those around."""
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows = []
            for a, c, k, before, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for low in range(0, side + 1, SPLIT):
                    high = min(low + SPLIT - 1, side)
                    start, end = before - low, before + length - high
                    if start >= 0 and end <= len(data):
                        rows.append((a, low, xxh3_64_intdigest(data[start:end]) - (1 << 63), c, k, data[max(0, before - high) : start], data[end : before + length - low]))
                if len(rows) > TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _DEALT.values())], names=list(_DEALT))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _DEALT.values())], names=list(_DEALT))

    # A repeated row of a document gives its contexts again; their count is over one in any case.
    crowd = contexts.select("anchor", "context", "n", "left", "bytes")
    dealt = common.cut(crowd.mapInArrow(deal, "anchor long, low long, core long, context long, n long, near binary, after binary"), "dealt")
    # Bytes that nobody else has in common share no window: they are told by their hashes alone, and go before windows are made.
    place, case = ["anchor", "low", "core"], ["anchor", "low", "core", "near", "after"]
    shared = dealt.groupBy(*place).agg(F.sum("n").alias("n"), F.count("*").alias("here")).where("n > 1").drop("n")
    joint = common.cut(common.weighted_join(dealt, common.cut(shared, "shared"), place, "here", "inner", common.meet).drop("here"), "joint")
    cases = common.cut(joint.groupBy(*case).agg(F.sum("n").alias("n"), F.count("*").alias("held")), "cases")
    cases = cases.withColumn("id", F.monotonically_increasing_id())
    wide = F.least(F.lit(SPLIT - 1), F.lit(side) - F.col("low"))
    each = cases.withColumn("shift", F.explode(F.sequence(F.lit(0), wide))).where((F.length("near") >= F.col("shift")) & (F.length("after") >= wide - F.col("shift")))
    head, tail = F.expr("substring(near, length(near) - shift + 1, shift)"), F.substring("after", F.lit(1), wide - F.col("shift"))
    each = each.select("id", (F.col("low") + F.col("shift")).cast("int").alias("at"), "n", *_both_hashes(*place, "shift", head, tail))
    repeated = each.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    # Keys come once on the right and windows are short, so large keys are left to the splitting of skewed partitions: to set them
    # apart would make and pass all windows, sixteen a case, once more.
    starts = common.meet(each.drop("n"), common.cut(repeated, "repeated"), ["h1", "h2"])
    span = starts.groupBy("id").agg((-F.max("at")).alias("from"), (length - F.min("at")).alias("to"))
    told = common.cut(common.meet(cases, span, ["id"]).select(*_both_hashes(*case), "held", "from", "to"), "told")
    found = common.weighted_join(joint.select("anchor", "context", *_both_hashes(*case)), told, ["h1", "h2"], "held", "inner", common.meet)
    return found.groupBy("anchor", "context").agg(F.min("from").cast("int").alias("from"), F.max("to").cast("int").alias("to"))


def _both_hashes(*columns) -> list:
    """h1 and h2, two 64-bit hashes of the columns: what is shuffled in place of the bytes."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


_REMOVED = T.StructType().add("kept", T.BinaryType()).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType())


@F.pandas_udf(_REMOVED)
def _cut_out(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s in zip(text, spans):
        data = t.encode("utf-8", "replace")
        kept, at, removed, n = [], 0, 0, 0
        for x in sorted((x["start"], x["end"]) for x in s) if s is not None else ():
            a, b = max(x[0], at), min(x[1], len(data))
            if b <= a and (n == 0 or x[0] > at):
                continue
            if n == 0 or x[0] > at:
                kept.append(data[at:a])
                n += 1
            removed += max(0, b - a)
            at = max(at, b)
        kept.append(data[at:])
        rows.append((b"".join(kept), len(data), removed, n))
    return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the kept bytes, n_bytes, n_removed and n_spans."""
    spans = repeated_spans(docs, length).select(F.col("doc").alias(_DOC), F.col("body").alias(_BODY), F.struct("start", "end").alias("span"))
    by_doc = common.cut(spans.groupBy(_DOC, _BODY).agg(F.collect_set("span").alias("__gm_spans")), "spans")
    kept = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    joined = common.meet(_keyed(docs), by_doc, [_DOC, _BODY], "left")
    done = joined.select(*kept, _cut_out("text", "__gm_spans").alias("__gm_done"))
    return done.select(*kept, "__gm_done.*")

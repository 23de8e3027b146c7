"""Phrases of two to four words that stand together: pair counts by direct-address tiles.

Words are numbered by falling frequency. A pair of numbers (a, b) belongs to
the tile (a // ``_TILE``, b // ``_TILE``) and has an address in it. A task
sorts the adjacent pairs of a few million words by tile; of a tile with enough
of them it counts all addresses in one dense ``bincount``, of a sparse one by
sorting (coordinates with counts). The tasks' counts of a tile are added up in
the same two ways, by address.

Longer phrases come by recursion. Frequent pairs are numbered by frequency
like words, every text becomes the row of its pairs' numbers, and adjacent
pairs of that row, which overlap in a word, are the phrases of three words;
once more for four. A phrase that is frequent enough has only parts that are,
so everything else becomes a gap (-1) before the next step.

Bounds. A task holds the ``_NUMBERED`` most frequent items of a step at most.
Where there are more frequent ones (the tail) these have 62-bit hashes as
numbers, a bitmap of fixed size tells which hashes may occur, and pairs with
such a number are counted by coordinates in hashed tiles. (Two tail phrases of
one language with equal hashes would be counted as one: unlikely below a
billion of them.) A tile whose counts come from very many tasks is first added
up in groups of ``_TOGETHER`` parts, again and again, so that no task meets
more than ``_CROWDED`` counts or ``_TOGETHER`` tiles.

Null texts are empty, a null language is ``und``. Repeated rows count each
time, null doc_ids as well; nothing but text and lang is read, and texts may have any length.
Ties in rank are broken by count and by the phrase's bytes. An empty table, or
one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SPLITS = b".,;:!?\x0a\x0b\x0c\x0d"
_TO_DOT = bytes.maketrans(_SPLITS, b"." * len(_SPLITS))
_SHIFT = 11
_TILE = 1 << _SHIFT
#: Share of a tile's addresses, as a power of two, from which it is counted densely.
_DENSE = _TILE * _TILE >> 4
#: Most frequent items of a step that a task holds by number.
_NUMBERED = 1 << 20
#: Words that a task gathers before it counts.
_GATHERED = 1 << 22
#: Counts of a tile that a task adds up, and parts of a larger one.
_CROWDED, _TOGETHER = 1 << 24, 8
#: Shares of a language in which phrases are ranked first.
_SHARES = 32
_TAIL = 1 << 62
_BITS = 27  # of the bitmap: 16 MB


def _tokens(text: str) -> list[bytes]:
    """The lower-cased words, with b"." between pieces (no word holds a full stop)."""
    return text.encode("utf-8", "replace").lower().translate(_TO_DOT).replace(b".", b" . ").split()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of tail pairs: 62 mixed bits above ``_TAIL``."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(2)).astype(np.int64) | np.int64(_TAIL)


def _word_tail(lang: str, word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode() + b"\0" + word) >> 2 | _TAIL


class _Numbers:
    """What a task knows of a step: each language's numbered items and the bitmap of the tail."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.by_lang: dict[str, tuple] = {}

    def tail(self, hashed: np.ndarray) -> np.ndarray:
        """The numbers themselves where the bitmap has them, else -1."""
        if self.bits is None:
            return np.full(len(hashed), -1, np.int64)
        at = hashed & ((1 << _BITS) - 1)
        return np.where(self.bits[at >> 3] >> (at & 7) & 1 == 1, hashed, -1)


class _Pairs(_Numbers):
    """Numbers of pairs; exact: places of a and of b among the known ones give one sorted key."""

    def add(self, lang: str, a: np.ndarray, b: np.ndarray) -> None:
        one, two = np.unique(a), np.unique(b)
        key = np.searchsorted(one, a) * np.int64(len(two)) + np.searchsorted(two, b)
        order = np.argsort(key)
        self.by_lang[lang] = (one, two, key[order], order)

    def of(self, lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64) if self.bits is None else self.tail(_mixed(a, b))
        if lang in self.by_lang and len(a):
            one, two, keys, numbers = self.by_lang[lang]
            i, j = np.minimum(np.searchsorted(one, a), len(one) - 1), np.minimum(np.searchsorted(two, b), len(two) - 1)
            key = i * np.int64(len(two)) + j
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = (one[i] == a) & (two[j] == b) & (keys[at] == key)
            out[found] = numbers[at[found]]
        return out


class _Words(_Numbers):
    def add(self, lang: str, words: list[bytes]) -> None:
        self.by_lang[lang] = {w: i for i, w in enumerate(words)}

    def of(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        known = self.by_lang.get(lang, {})
        ids = np.array([known.get(t, -1) for t in tokens], np.int64)
        if self.bits is not None:
            rest = [i for i in np.flatnonzero(ids < 0) if tokens[i] != b"."]
            ids[rest] = self.tail(np.array([_word_tail(lang, tokens[i]) for i in rest], np.int64))
        return ids


def _adjacent(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = ids[:-1], ids[1:]
    both = (a >= 0) & (b >= 0)
    return a[both], b[both]


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates with their counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(counts[order], starts) if len(found) else counts[:0]


def _dense(cells: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All addresses of a tile at once; sums are exact below 2**53."""
    total = np.bincount(cells, counts, _TILE * _TILE)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.int64)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    """Number, steps of the sorted addresses and counts, in four bytes each where counts fit."""
    narrow = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return len(keys), np.diff(keys, prepend=0).astype(np.uint32).tobytes(), counts.astype(narrow).tobytes()


def _unpacked(entries: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    narrow = np.uint32 if len(counts) == 4 * entries else np.uint64
    return np.cumsum(np.frombuffer(keys, np.uint32).astype(np.int64)), np.frombuffer(counts, narrow).astype(np.int64)


def _tiles(lang: str, ids: np.ndarray) -> Iterator[tuple]:
    """(lang, tile_a, tile_b, entries, keys, counts) of the adjacent numbers; pairs themselves, with tile_a -1, where a number is of the tail."""
    a, b = _adjacent(ids)
    low = (a < _TAIL) & (b < _TAIL)
    across = int(b[low].max(initial=0) >> _SHIFT) + 1
    tile = (a[low] >> _SHIFT) * across + (b[low] >> _SHIFT)
    order = np.argsort(tile, kind="stable")
    cells = ((a[low] & (_TILE - 1)) << _SHIFT | b[low] & (_TILE - 1))[order]
    names, starts = np.unique(tile[order], return_index=True)
    for name, start, end in zip(names.tolist(), starts, [*starts[1:], len(order)]):
        yield lang, name // across, name % across, *_packed(*(_dense if end - start >= _DENSE else _summed)(cells[start:end]))
    if not low.all():
        pairs, counts = np.unique(np.stack([a[~low], b[~low]], 1), axis=0, return_counts=True)
        yield lang, -1, -1, len(pairs), pairs.tobytes(), counts.astype(np.int64).tobytes()


def _map_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gathered: dict[str, list[np.ndarray]] = defaultdict(list)
    size = 0

    def counted() -> Iterator[pd.DataFrame]:
        for lang, ids in gathered.items():
            if rows := list(_tiles(lang, np.concatenate(ids))):
                yield pd.DataFrame(rows, columns=["lang", "tile_a", "tile_b", "entries", "keys", "counts"])

    gap = np.array([-1], np.int64)
    for pdf in batches:
        for lang, ids in zip(pdf["lang"], pdf["ids"]):
            gathered[lang] += [ids, gap]
            size += len(ids)
            if size >= _GATHERED:
                yield from counted()
                gathered.clear()
                size = 0
    yield from counted()


def _total(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Addresses and sums of a tile's parts."""
    parts = [_unpacked(*part) for part in zip(pdf["entries"], pdf["keys"], pdf["counts"])]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    return (_dense if len(keys) >= _DENSE else _summed)(keys, counts)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    name = pdf.iloc[0]
    return pd.DataFrame([(name["lang"], name["tile_a"], name["tile_b"], *_packed(*_total(pdf)))], columns=["lang", "tile_a", "tile_b", "entries", "keys", "counts"])


def _frequent(least: int):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf.iloc[0]
        cells, total = _total(pdf)
        cells, total = cells[total >= least], total[total >= least]
        return pd.DataFrame({"lang": name["lang"], "a": (int(name["tile_a"]) << _SHIFT) + (cells >> _SHIFT), "b": (int(name["tile_b"]) << _SHIFT) + (cells & (_TILE - 1)), "f": total})

    return add


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, keys, counts in zip(pdf["lang"], pdf["keys"], pdf["counts"]):
            pairs = np.frombuffer(keys, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"lang": lang, "a": pairs[:, 0], "b": pairs[:, 1], "f": np.frombuffer(counts, np.int64)})


def count_pairs(ids: DataFrame, least: int) -> DataFrame:
    """(lang, a, b, f): adjacent numbers in the rows (lang, ids) found ``least`` times or more in a language."""
    shape, tile = "lang string, tile_a long, tile_b long, entries long, keys binary, counts binary", ["lang", "tile_a", "tile_b"]
    counted = common.cut(ids.mapInPandas(_map_tiles, shape), "tiles")
    tail, tiles = counted.where("tile_a < 0"), counted.where("tile_a >= 0")
    while True:
        sizes = tiles.groupBy(*tile).agg(F.count("*").alias("parts"), F.sum("entries").alias("all"))
        crowded = common.cut(sizes.where((F.col("all") > _CROWDED) & (F.col("parts") > _TOGETHER)), "crowded")
        if crowded.isEmpty():
            break
        slots = F.ceil(F.col("parts") / _TOGETHER)
        dealt = tiles.join(crowded, tile).withColumn("slot", F.pmod(F.xxhash64("keys", "counts"), slots))
        tiles = common.cut(tiles.join(crowded, tile, "left_anti").unionByName(dealt.groupBy(*tile, "slot").applyInPandas(_merge, shape)), "tiles")
    frequent = tiles.groupBy(*tile).applyInPandas(_frequent(least), "lang string, a long, b long, f long")
    others = tail.mapInPandas(_pairs, "lang string, a long, b long, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return common.cut(frequent.unionByName(others), "pairs")


def _bitmap(tail: DataFrame) -> np.ndarray | None:
    """Bits of the numbers in ``tail`` (number), put together by Spark; 2**_BITS of them at most."""
    at = F.col("number").bitwiseAND((1 << _BITS) - 1)
    words = tail.groupBy(F.shiftright(at, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(number & 31 as int))")).alias("bits")).toPandas()
    if words.empty:
        return None
    bits = np.zeros(1 << (_BITS - 5), np.uint32)
    bits[words["word"]] = words["bits"].astype(np.uint32)
    return bits.view(np.uint8)


def _numbered(items: DataFrame, order: list, keys: list[str], numbered: int) -> pd.DataFrame:
    """The most frequent items, ``numbered`` at most, in falling frequency."""
    return items.orderBy(F.desc("f"), "lang", *order).limit(numbered).select("lang", *keys).toPandas()


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, numbered: int = _NUMBERED) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase found ``least`` times or more, and (lang, n): all word occurrences."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(common.text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, group in pdf.groupby("lang")["text"]:
                counts: Counter = Counter()
                for text in group:
                    counts.update(_tokens(text))
                del counts[b"."]
                yield pd.DataFrame({"lang": lang, "phrase": [w.decode() for w in counts], "f": list(counts.values())})

    words = common.cut(texts.mapInPandas(count_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    top = _numbered(words, ["phrase"], ["phrase"], numbered)

    def number_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words_sent.value
        for pdf in batches:
            number = [known.by_lang.get(lang, {}).get(w.encode(), -1) for lang, w in zip(pdf["lang"], pdf["phrase"])]
            pdf["number"] = [_word_tail(lang, w.encode()) if i < 0 else i for lang, w, i in zip(pdf["lang"], pdf["phrase"], number)]
            pdf["last"] = pdf["phrase"]
            yield pdf[["lang", "number", "phrase", "last", "f"]]

    def sent(kind: type[_Numbers], of_words: bool, more: DataFrame | None):
        numbers = kind(None if more is None else _bitmap(more))
        for lang, group in top.groupby("lang"):
            numbers.add(lang, *([[w.encode() for w in group["phrase"]]] if of_words else [group["a"].to_numpy(), group["b"].to_numpy()]))
        return spark.sparkContext.broadcast(numbers)

    shape = "lang string, number long, phrase string, last string, f long"
    words_sent = sent(_Words, True, None)
    items = common.cut(words.mapInPandas(number_words, shape), "items")
    if len(top) == numbered:
        words_sent.destroy()
        words_sent = sent(_Words, True, items.where(F.col("number") >= _TAIL))
    word_numbers = words_sent

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_numbers.value
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "ids": [known.of(lang, _tokens(text)) for lang, text in zip(pdf["lang"], pdf["text"])]})

    ids = common.cut(texts.mapInPandas(ids_of, "lang string, ids array<long>"), "ids")
    word_numbers.destroy()  # what it served is written; the driver keeps one step's numbers at a time
    levels = [items.select("lang", "phrase", F.lit(1).alias("words"), "f")]
    for length in range(2, longest + 1):
        pairs = count_pairs(ids, least)
        top = _numbered(pairs, ["a", "b"], ["a", "b"], numbered)
        pairs_sent = sent(_Pairs, False, None)

        def number_pairs(batches: Iterator[pd.DataFrame], known=pairs_sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["number"] = -1
                for lang, group in pdf.groupby("lang"):
                    a, b = group["a"].to_numpy(), group["b"].to_numpy()
                    number = known.value.of(lang, a, b)
                    pdf.loc[group.index, "number"] = np.where(number < 0, _mixed(a, b), number)
                yield pdf[["lang", "number", "a", "b", "f"]]

        numbered_pairs = common.cut(pairs.mapInPandas(number_pairs, "lang string, number long, a long, b long, f long"), "numbered")
        if len(top) == numbered:
            pairs_sent.destroy()
            pairs_sent = sent(_Pairs, False, numbered_pairs.where(F.col("number") >= _TAIL).select("number"))
        one = items.select("lang", F.col("number").alias("a"), "phrase")
        two = items.select("lang", F.col("number").alias("b"), F.col("last"))
        items = common.cut(numbered_pairs.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "number", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"), "items")
        levels.append(items.select("lang", "phrase", F.lit(length).alias("words"), "f"))
        if length == longest:
            pairs_sent.destroy()
            break

        def next_ids(batches: Iterator[pd.DataFrame], known=pairs_sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [np.empty(0, np.int64)] * len(pdf)
                for lang, places in pdf.groupby("lang").indices.items():
                    rows = [pdf["ids"].iat[i] for i in places]
                    flat = np.concatenate(rows)
                    number = np.full(len(flat), -1, np.int64)  # of the pair that begins here; a row's last place has none
                    if len(flat) > 1:
                        both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
                        number[both] = known.value.of(lang, flat[both], flat[both + 1])
                    end = 0
                    for i, row in zip(places, rows):
                        end += len(row)
                        out[i] = number[end - len(row) : max(end - len(row), end - 1)]
                yield pd.DataFrame({"lang": pdf["lang"], "ids": out})

        ids = common.cut(ids.mapInPandas(next_ids, "lang string, ids array<long>"), "ids")
        pairs_sent.destroy()
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return common.cut(counts, "counts"), totals


def mine(docs: DataFrame, least: int = 30, longest: int = 4, contained: int = 80, top: int = 2000, numbered: int = _NUMBERED) -> DataFrame:
    """The first ``top`` phrases of each language by the score of their weakest cut.

    Phrases inside a longer one that has ``contained`` percent of their count or more are left out.
    """
    counts, totals = phrase_counts(docs, least, longest, numbered)
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    part = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) as long)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: joined(i, n))))
    inner = phrases.where(F.size("w") > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(contained) * F.col("x.a")))
    ranked = kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    by_score = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # First within shares of a language, so that its last task ranks a bounded number of phrases.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SHARES))).orderBy(*by_score)
    ranked = ranked.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*by_score)
    first = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

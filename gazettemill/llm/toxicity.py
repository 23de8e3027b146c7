"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

The example set is a bounded sample of labelled rows (``max_examples``, the
smallest hashes of doc_id; a documented parameter). Its vocabulary is every
word of theirs and every prefix of four to six letters, for inflected and
invented forms; words that no example holds are outside the vector space.
Weights are log term frequencies times inverse document frequencies, counted
over all documents, times a relevance: ``FLOOR`` for any term, more for one
that tells toxic examples from others (the lower bound of its log odds over
different texts, so that neither rare words nor copies count for much).

Examples are kept in an inverted index. Postings of terms in up to a
``COMMON`` th of the examples are read whole; those of common terms lie in
blocks of ``BLOCK`` examples, each with its largest weight, and a block whose
bound is below the k-th best cosine is never opened. The neighbours found are
exact (all ties of the k-th are taken). An example never is its own text's
neighbour.
Votes are weighted by similarity, shrunk towards the base rate, and calibrated
by isotonic regression on the votes of the examples themselves.

Null and empty texts have the zero vector, as any text without a known term;
these get the calibrated rate of such examples. Documents with null or
repeated doc_id are scored each. Repeated labels of a doc_id count as toxic
if any is; null labels are left out. Without usable labels every score is 0.
Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 64
COMMON = 16
#: Texts whose neighbours are sought together.
TOGETHER = 256
#: Words a worker remembers from one batch to the next.
REMEMBERED = 500_000
FLOOR = 0.05
#: Standard errors between a term's log odds and their lower bound.
CAUTION = 2.0
_WORD = re.compile(r"\w+")
_PREFIXES = (4, 5, 6)


def _hashes(word: str) -> list[int]:
    """Hashes of a word and of its prefixes (marked ``-``)."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(word), *(xxh3_64_intdigest(word[:k] + "-") for k in _PREFIXES if len(word) > k)]


def _copy_key(text: str) -> int:
    """Smallest hash of the five-word shingles: alike for near copies."""
    from xxhash import xxh64_intdigest

    words = text.split()
    return min(xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) - (1 << 63)


def _text_key(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one range after the other."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class Words(dict):
    """The integers that ``make`` gives for a word, remembered for all words met; texts are counted by them."""

    def __init__(self, make):
        self.make = make
        self._forget()

    def _forget(self) -> None:
        self.clear()
        # Integers of word i: flat[starts[i] : starts[i + 1]].
        self.flat, self.starts = array("Q", [0]), array("q", [1])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.make(word))
        self[word] = len(self.starts) - 1
        self.starts.append(len(self.flat))
        return self[word]

    def counted(self, texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The different integers of each text's words, in order, and their counts."""
        if len(self) > REMEMBERED:
            self._forget()
        number = self.__getitem__
        texts = [np.array(list(map(number, _WORD.findall(text.lower()))), np.int64) for text in texts]
        flat, starts = np.frombuffer(self.flat, np.uint64), np.frombuffer(self.starts, np.int64)
        out = []
        for words in texts:
            words.sort()
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else words
            times, words = np.diff(np.append(first, len(words))), words[first]
            lows, highs = starts[words], starts[words + 1]
            found, times = flat[_ranges(lows, highs)], np.repeat(times, highs - lows)
            order = np.argsort(found)
            found, times = found[order], times[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else found.astype(np.int64)
            out.append((found[first], np.add.reduceat(times, first) if len(first) else first))
        return out


def features(texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and word prefixes of each text, in order, and their counts."""
    return Words(_hashes).counted(texts)


class Vocabulary:
    """The examples' terms by hash, in order; a worker remembers those of the words it met."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    @cached_property
    def _words(self) -> Words:
        numbers = dict(zip(self.terms.tolist(), range(len(self.terms))))
        return Words(lambda word: [numbers[h] for h in _hashes(word) if h in numbers])

    def known(self, texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and counts of the known terms of each text."""
        return [(ids.astype(np.int32), counts) for ids, counts in self._words.counted(texts)]


def relevance(term: np.ndarray, example: np.ndarray, toxic: np.ndarray, copies: np.ndarray, n_terms: int) -> np.ndarray:
    """FLOOR for each term, and the lower bound of its log odds in either class; near copies count once."""
    label = np.bincount(copies, toxic) > 0
    pairs = np.unique(term.astype(np.int64) * len(label) + copies[example])
    at, of = pairs // len(label), label[pairs % len(label)]
    a, b = np.bincount(at[of], minlength=n_terms), np.bincount(at[~of], minlength=n_terms)
    odds = np.log((a + 0.5) / (label.sum() - a + 0.5)) - np.log((b + 0.5) / ((~label).sum() - b + 0.5))
    return FLOOR + np.maximum(0, np.abs(odds) - CAUTION * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


class Index:
    """Unit vectors of the examples by term, in blocks with their largest weights."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels, doc_ids, keys, weight: np.ndarray, k: int):
        self.weight, self.k = weight, k
        units = [self.vector(*v) for v in vectors]
        # Examples with the same leading term stand together, which makes block bounds tight.
        lead = [int(v[0][u.argmax()]) if len(u) else -1 for v, u in zip(vectors, units)]
        order = np.lexsort((np.arange(len(lead)), lead))
        self.labels, self.doc_ids, self.keys = (np.array(x)[order] for x in (labels, doc_ids, keys))
        sizes = np.array([len(units[i]) for i in order], np.int64)
        term = np.concatenate([vectors[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(order)), sizes)
        unit = np.concatenate([units[i] for i in order]) if len(order) else np.zeros(0, np.float32)
        by_term = np.lexsort((owner, term))
        term, owner, unit = term[by_term], owner[by_term], unit[by_term]
        n = np.bincount(term, minlength=len(weight))
        self.n_blocks = -(-len(order) // BLOCK)
        often = np.flatnonzero(n > len(order) / COMMON)
        self.row = np.full(len(weight), -1)  # of a common term
        self.row[often] = np.arange(len(often))
        self.blocks = np.zeros((len(often), self.n_blocks * BLOCK), np.float32)
        wide = self.row[term] >= 0
        self.blocks[self.row[term[wide]], owner[wide]] = unit[wide]
        self.blocks = self.blocks.reshape(len(often), self.n_blocks, BLOCK)
        self.most = self.blocks.max(axis=2, initial=0)
        self.example, self.unit = owner[~wide].astype(np.int32), unit[~wide]
        self.starts = np.searchsorted(term[~wide], np.arange(len(weight) + 1))
        self.alike: dict[int, list[int]] = {}
        for i, key in enumerate(self.keys.tolist()):
            self.alike.setdefault(key, []).append(i)
        self.base = float(self.labels.mean()) if len(self.labels) else 0.0
        empty = self.labels[sizes == 0]
        self.empty_rate = float((empty.sum() + self.base) / (len(empty) + 1))

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.weight[ids]
        return (v / np.sqrt((v * v).sum())).astype(np.float32) if len(v) else np.zeros(0, np.float32)

    def neighbours(self, ids: list[np.ndarray], units: list[np.ndarray], without: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest examples of each vector and all ties of the k-th; cosine 0 is no neighbour."""
        out = []
        for lo in range(0, len(ids), TOGETHER):
            some = slice(lo, lo + TOGETHER)
            out += self._nearest(ids[some], units[some], without[some])
        return out

    def _nearest(self, ids, units, without) -> list[tuple[np.ndarray, np.ndarray]]:
        n, width = len(ids), self.n_blocks * BLOCK
        common_part = np.zeros((n, len(self.blocks)), np.float32)
        cosine = np.zeros((n, width), np.float32)
        for j, (i, unit) in enumerate(zip(ids, units)):
            rows = self.row[i]
            wide = rows >= 0
            common_part[j, rows[wide]] = unit[wide]
            starts, ends = self.starts[i], self.starts[i + 1]
            postings = _ranges(starts, ends)
            cosine[j] = np.bincount(self.example[postings], np.repeat(unit, ends - starts) * self.unit[postings], width)
            cosine[j, without[j]] = -2  # never reaches 0
        k = min(self.k, width)
        if not k:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        floor = np.maximum(np.partition(cosine, -k, axis=1)[:, -k], 0)
        bound = cosine.reshape(n, self.n_blocks, BLOCK).max(axis=2) + common_part @ self.most
        order = np.argsort(-bound.max(axis=0), kind="stable")
        seen = np.zeros((n, width), np.float32)
        for at, b in enumerate(order):
            asks = np.flatnonzero(bound[:, b] >= np.maximum(floor - 1e-6, 1e-9))
            if len(asks):
                own = slice(b * BLOCK, (b + 1) * BLOCK)
                if len(asks) == n:
                    seen[:, own] = cosine[:, own] + common_part @ self.blocks[:, b]
                else:
                    seen[asks, own] = cosine[asks, own] + common_part[asks] @ self.blocks[:, b]
            if at == 7:
                floor = np.maximum(floor, np.partition(seen, -k, axis=1)[:, -k])
        floor = np.maximum(np.partition(seen, -k, axis=1)[:, -k], 0)
        found = (np.flatnonzero(row > max(least - 1e-6, 1e-6)) for row, least in zip(seen, floor))
        return [(at, row[at]) for at, row in zip(found, seen)]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """Similarity-weighted share of toxic neighbours, shrunk by one example of the base rate."""
        return float(((cos * self.labels[at]).sum() + self.base) / (cos.sum() + 1))

    def judge(self, texts: list[tuple[np.ndarray, np.ndarray]], keys: list[int]) -> list[tuple[float, list[dict]]]:
        """The vote and the five nearest examples of each text's vector; -1 for the zero vector."""
        ids = [i for i, _ in texts]
        near = self.neighbours(ids, [self.vector(*t) for t in texts], [self.alike.get(key, []) for key in keys])
        out = []
        for i, (at, cos) in zip(ids, near):
            top = np.lexsort((self.doc_ids[at], -cos))[:5]
            evidence = [{"doc_id": int(self.doc_ids[a]), "similarity": round(float(c), 6), "toxic": int(self.labels[a])} for a, c in zip(at[top], cos[top])]
            out.append((self.vote(at, cos) if len(i) else -1.0, evidence))
        return out


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; level and rate of each pool, smoothed by half a case."""
    pools: list[list[float]] = []  # sum x, sum y, n
    order = np.argsort(x, kind="stable")
    for a, b in zip(x[order], y[order]):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s, t, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + t, pools[-1][2] + n]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * (p[1] / p[2])) / (p[2] + 0.5) for p in pools])


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows that may be learned from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.where(~held_out("doc_id"))


class Examples(NamedTuple):
    """The labelled examples by doc_id, their terms and counts one example after the other."""

    doc_id: np.ndarray
    toxic: np.ndarray
    copy: np.ndarray
    own: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, max_examples: int) -> Examples:
    """At most ``max_examples`` labelled documents; their terms are hashes."""
    chosen = common.cut(_learnable(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples), "chosen")
    texts = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("toxicity, examples")
        for pdf in batches:
            found = features(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "copy": [_copy_key(t) for t in pdf["text"]], "own": [_text_key(t) for t in pdf["text"]], "terms": [h.view(np.int64) for h, _ in found], "counts": [c.astype(np.int32) for _, c in found]})

    rows = texts.mapInPandas(read, "doc_id long, toxic int, copy long, own long, terms array<long>, counts array<int>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    flat = {name: rows[name].combine_chunks() for name in rows.column_names}
    plain = [flat[name].to_numpy(zero_copy_only=False) for name in ("doc_id", "toxic", "copy", "own")]
    terms, counts = (flat[name].flatten().to_numpy(zero_copy_only=False) for name in ("terms", "counts"))
    return Examples(*plain, np.diff(flat["terms"].offsets.to_numpy()), terms.view(np.uint64), counts)


def fit(examples: Examples, df: np.ndarray, n_docs: int, k: int) -> Index:
    """The index over the examples, whose terms are numbers, with these document frequencies."""
    n, toxic = len(examples.sizes), examples.toxic.astype(np.int64)
    copies = np.unique(examples.copy, return_inverse=True)[1]
    weight = np.log((1 + n_docs) / (1 + df)) + 1
    if n:
        weight = weight * relevance(examples.terms, np.repeat(np.arange(n), examples.sizes), toxic, copies, len(df))
    ends = np.cumsum(examples.sizes)
    vectors = [(examples.terms[b - m : b].astype(np.int64), examples.counts[b - m : b]) for b, m in zip(ends.tolist(), examples.sizes.tolist())]
    return Index(vectors, toxic.astype(np.float64), examples.doc_id, examples.own, weight, k)


class Deferred:
    """An index that each worker builds for itself, once, from what is broadcast: the driver never holds it."""

    def __init__(self, *parts):
        self.parts = parts

    def __reduce__(self):
        return Deferred, self.parts

    @cached_property
    def index(self) -> Index:
        return fit(*self.parts)


def score(docs: DataFrame, labels: DataFrame, max_examples: int = 2500, k: int = 25) -> DataFrame:
    """(doc_id, score, evidence) of every document; evidence: up to five nearest examples (doc_id, similarity, toxic)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    examples = sample(texts, labels, max_examples)
    terms, number = np.unique(examples.terms, return_inverse=True)
    examples = examples._replace(terms=number.astype(np.int32))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(terms))  # the examples' terms, bounded by max_examples

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("toxicity, words")
        for pdf in batches:
            found = vocabulary.value.known(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "own": [_text_key(t) for t in pdf["text"]], "ids": [i for i, _ in found], "counts": [c.astype(np.int32) for _, c in found]})

    sparse = common.cut(texts.mapInPandas(vectors, "doc_id long, own long, ids array<int>, counts array<int>"), "vectors")
    counted = sparse.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toPandas()  # at most a row for each term
    df = np.zeros(len(terms), np.int64)
    df[counted["term"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(Deferred(examples, df, sparse.count(), k))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("toxicity, index")
        for pdf in batches:
            found = shared.value.index.judge([(i.astype(np.int64), c) for i, c in zip(pdf["ids"], pdf["counts"])], pdf["own"].tolist())
            yield pd.DataFrame({"toxic": pdf["toxic"], "vote": [v for v, _ in found]})

    # The examples' own votes, found in tasks; at most max_examples rows.
    known = spark.createDataFrame(list(zip(*(x.tolist() for x in (examples.doc_id, examples.own, examples.toxic)))), "doc_id long, own long, toxic int")
    voted = sparse.join(F.broadcast(known), ["doc_id", "own"]).dropDuplicates(["doc_id"]).mapInPandas(votes, "toxic int, vote double").toPandas()
    voted = voted.sort_values(["vote", "toxic"])
    voted = voted[voted["vote"] >= 0]
    base = float(examples.toxic.mean()) if len(examples.toxic) else 0.0
    levels, rates = _isotonic(voted["vote"].to_numpy(np.float64), voted["toxic"].to_numpy(np.float64)) if len(voted) else (np.array([0.0]), np.array([base]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.take_over("toxicity, index")
        for pdf in batches:
            once = ~pdf["own"].duplicated()  # copies within a batch
            some = pdf[once]
            known = dict(zip(some["own"], shared.value.index.judge([(i.astype(np.int64), c) for i, c in zip(some["ids"], some["counts"])], some["own"].tolist())))
            found = [known[t] for t in pdf["own"]]
            vote = np.array([v for v, _ in found])
            scores = np.where(vote < 0, shared.value.index.empty_rate, np.interp(vote, levels, rates))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": np.clip(scores, 0, 1), "evidence": [e for _, e in found]})

    return sparse.mapInPandas(judge, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")


def flagged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document."""
    found = score(docs, labels, **params)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

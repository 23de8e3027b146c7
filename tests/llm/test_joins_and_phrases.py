"""Whitening, n-gram joins and phrases against plain Python, numpy and DuckDB."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gazettemill.llm import collocations, ngramjoin, queries, whitening

duckdb = pytest.importorskip("duckdb")


def _key(value):
    return "~" if value is None else str(value)


@pytest.mark.parametrize("name", ["op12_ngram_jaccard", "op13_collocations"])
def test_whole_table_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(_key(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(_key(v) for v in r) for r in df.select(columns).collect()) == want and want


def _whitened(x, k):
    """Numpy's n, deviations, |scores| by component and explained shares of integer vectors."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return n, deviation, np.abs((n * x - s) / n @ (axes[:, :k] / np.sqrt(values[:k]))), values[:k] / values.sum()


def test_whitening_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    n, deviation, scores, explained = _whitened(x, 4)
    got = {(r["vec_id"], r["component"]): r for r in queries.queries()["op11_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(rows)
    for i, r in enumerate(rows):
        for c in range(4):
            g = got[r["vec_id"], c + 1]
            assert (g["n"], g["deviation"]) == (n, deviation[i]) and abs(abs(g["whitened"]) - scores[i, c]) < 1e-9 and abs(g["explained"] - explained[c]) < 1e-9 and g["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark, monkeypatch):
    """Blocks of 8 rows over several partitions; copies, null and odd entries, null ids, short and huge vectors, clashing columns."""
    monkeypatch.setattr(whitening, "_CELLS", 24)
    monkeypatch.setattr(whitening, "_SHARE", 2)
    rng = random.Random(1)
    vectors = [[round(rng.gauss(0, s), 3) for s in (1.0, 0.5, 0.2)] for _ in range(70)]
    rows = [(i, v, 0, 0) for i, v in enumerate(vectors)] + [(5, vectors[5], 1, 1), (None, vectors[0], 1, 1), (7, vectors[9], 1, 1), (200, [0.5], 1, 1), (201, [], 1, 1), (202, [0.0, -0.0, 0.0], 1, 1)]
    rows += [(300, None, 0, 0), (301, [1.0, None, 2.0], 0, 0), (302, [1.0, float("nan"), 2.0], 0, 0), (303, [float("inf"), 1.0, 1.0], 0, 0)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, k1 int").repartition(5)
    done = whitening.whiten(table, components=2)
    kept = [(i, np.floor(256 * np.array([*v, 0.0, 0.0, 0.0][:3])).astype(np.int64)) for i, v, _, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, deviation, scores, explained = _whitened(np.array([v for _, v in kept]), 2)
    want = sorted((-1 if i is None else i, d, *np.round(s, 8)) for (i, _), d, s in zip(kept, deviation, scores))
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], *np.round(np.abs(r["whitened"]), 8)) for r in done.rows.collect())
    assert done.n == n and np.allclose(got, want, atol=1e-7) and np.allclose(done.explained, explained) and done.identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 0.0])], "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: r["deviation"] for r in huge.rows.collect()} == {1: None, 2: 512**2 + 1, 3: None}


def test_whitening_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.by_component(whitening.whiten(spark.createDataFrame(rows, schema))).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(6)], schema))
    assert len(flat.explained) == 1 and flat.rows.count() == 6  # one component exists


def _groups(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset([b" ".join(w)] if 0 < len(w) < size else [b" ".join(w[j : j + size]) for j in range(len(w) - size + 1)]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and (a == b or None not in (rows[i][0], rows[j][0])):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((-1 if doc is None else doc, len(sets[i]), least.get(find(i), -1)) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [90, 80])
def test_ngram_join_against_all_pairs(spark, percent):
    """Groups of copies with few and many edits, around the bound in both directions; odd rows and clashing columns."""
    rng = random.Random(percent)
    texts = []
    for base in range(6):
        words = [f"b{base}_{i}" for i in range(rng.choice([11, 12, 20, 40, 90, 200]))]
        for _ in range(40):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w + [f"x{rng.randrange(9)}"] * rng.choice([0, 0, 1, 3])))
    texts += ["", None, "a", "a b", "A  B\t", "a b c", "\t\n", "é É", " ".join(f"l{i % 977}" for i in range(60_000))]
    rows = [*enumerate(texts), (None, texts[0]), (None, "only a null id"), (3, texts[50]), (7, texts[7]), (9000, texts[248])]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row int, n long, columns string").repartition(7)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in ngramjoin.join(table, 3, percent).collect())
    assert got == _groups(rows, 3, percent)


def test_ngram_join_of_nothing(spark):
    schema = "doc_id long, text string"
    assert ngramjoin.join(spark.createDataFrame([], schema)).count() == 0
    assert sorted(map(tuple, ngramjoin.join(spark.createDataFrame([(2, None), (1, " ")], schema)).collect())) == [(1, 0, 1), (2, 0, 2)]


def _phrases(rows):
    found = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    found["und" if lang is None else lang, " ".join(words[i : i + k])] += 1
    return found


def _ranked(rows, least, contained, top):
    f = _phrases(rows)
    out = []
    candidates = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        score, k = min((2000000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w)))
        longer = [b for (other, p), b in candidates.items() if other == lang and p != phrase and f" {phrase} " in f" {p} "]
        if not any(100 * b >= contained * a for b in longer):
            out.append((lang, -score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            n = sum(c for (other, p), c in f.items() if other == lang and " " not in p)
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return result


def _prose(seed):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 2 else f"é{i}" for i in range(60)]
    ends = [".", "; x x x x", "\n", "!? a\tb ", " c"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 80))) + rng.choice(ends), rng.choice(["en", "fr", "", None])) for i in range(300)]
    return rows + [(1, rows[1][1], "en")] * 3 + [(None, "x x x x x x", "en"), (None, None, "fr"), (5, "", None), (6, "w1 w3 " * 3000, "de")]


@pytest.mark.parametrize("numbered,crowded,together", [(1 << 20, 1 << 24, 8), (7, 1 << 24, 8), (1 << 20, 10, 2), (7, 10, 2)])
def test_phrase_counts(spark, monkeypatch, numbered, crowded, together):
    """All items numbered or most in the tail; tiles added at once or in rounds: the same exact counts."""
    monkeypatch.setattr(collocations, "_CROWDED", crowded)
    monkeypatch.setattr(collocations, "_TOGETHER", together)
    rows = _prose(1)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12)
    got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(table, 5, 4, numbered)[0].collect()}
    assert got == {k: n for k, n in _phrases(rows).items() if n >= 5}


def test_phrases_ranked(spark):
    rows = _prose(2)
    table = spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "doc_id long, text string, lang string, f int, phrase string, number long").repartition(5)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(table, 5, 4, 80, 25).collect())
    assert got == sorted(_ranked(rows, 5, 80, 25)) and len(got) > 50
    assert collocations.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).count() == 0


def test_dense_and_sparse_tiles_agree():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, collocations._TILE**2, 200_000)
    for one, two in zip(collocations._dense(cells), collocations._summed(cells)):
        assert np.array_equal(one, two)
    keys, counts = collocations._summed(cells)
    packed = collocations._packed(keys, counts << 40)
    assert all(np.array_equal(a, b) for a, b in zip(collocations._unpacked(*packed), (keys, counts << 40)))


def test_only_sets_of_paired_rows_are_shuffled(spark):
    from gazettemill.llm import common

    rng = np.random.default_rng(6)
    rows = [(i, np.unique(rng.integers(0, 1 << 60, 1000)).tolist()) for i in range(200)]
    rows[7] = (7, sorted([*rows[3][1][:990], *range(10)]))
    sets = common.cut(spark.createDataFrame(rows, "row long, columns array<long>"), "sets")
    pairs = common.cut(spark.createDataFrame([(3, 7), (3, 9)], "a long, b long"), "pairs")

    def shuffled():
        jvm = spark.sparkContext._gateway
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
        got = [tuple(r) for r in ngramjoin._similar(pairs, sets, 90).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [(3, 7)]
    assert shuffled() - before < 200_000  # the sets are 1.6 MB


def test_ngram_join_with_columns_that_agree_in_part(spark, monkeypatch):
    """Shortened hashes of columns lose no link and make none, even if most columns of a row agree with another."""
    monkeypatch.setattr(ngramjoin, "_COLUMN_BITS", 6)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"e{rng.randrange(10**6)}"] + base[k + 1 :]) for k in rng.sample(range(120), 25)]
    texts += [" ".join(f"o{n}_{i}" for i in range(100)) for n in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == _groups(rows, 3, 90)


def test_ngram_join_screens_rows_that_share_with_unlike_ones(spark, monkeypatch):
    """Rows with under two fifths of their columns in others are similar to none: their whole sets are not made."""
    made, cut = {}, ngramjoin.common.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "named":
            made[name] = out.count()
        return out

    monkeypatch.setattr(ngramjoin.common, "cut", counted)
    passage = " ".join(f"p{i}" for i in range(684))
    rows = [(i, passage + " " + " ".join(f"w{i}_{k}" for k in range(1116))) for i in range(20)]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert made["named"] <= 3

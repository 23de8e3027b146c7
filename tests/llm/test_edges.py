"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gazettemill.llm import ctph, decontam, htmlmain, linededup, packing, queries, secrets, simhash, suffixdedup, tokenfiles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, fp string, bitmap string, row long, length int, host string, kept string, ids string, doc string, body string, spans string, r string, n int, h string, m int, start int, part int, noise string"
LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "one"), (6, LONG), (7, LONG), (7, LONG), (None, "no id at all here"), (8, None),
    (9, f"start of nine {PASSAGE} end of nine"), (10, f"ten begins {PASSAGE} ten stops"), (11, "ÄÖÜ ß 東京   line " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 4 else "src", None, "a", "f", "b", 1, 2, "h", "k", "i", "user's doc", "user's body", "s", "r", 3, "h", 4, 5, 6, "x") for n, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    zero = "0" * 16
    assert by[1, zero] == by[2, zero] == by[3, zero] == by[8, zero] == 1
    assert {c for (i, _), c in by.items() if i in (6, 7)} == {6}
    assert {c for (i, _), c in by.items() if i in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_crowded_cells_are_exact(spark):
    """More fingerprints around one cell than are paired one by one."""
    import itertools

    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ 1 << i for i in range(40)] + [base ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(0, 60, 7), 2)] + [~base & (1 << 63) - 1]
    rows = [(i, x) for i, x in enumerate(dict.fromkeys(prints))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert {got[i] for i, x in rows if (x ^ base).bit_count() <= 2} == {0}
    assert got[len(rows) - 1] == len(rows) - 1


def test_similar_groups(docs, none):
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs).collect()}
    assert got[7] == got[6] == 6 and got[5] == got[4] == 4 and 11 not in got
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {1, 4, 6, 9, 11, None}
    assert simhash.similar_groups(none).count() == 0


def test_similar_groups_in_a_crowd(spark):
    """A passage that all texts share is most of each; the pairs are unlike all the others."""
    passage = [f"shared{i}" for i in range(80)]
    texts = []
    for i in range(300):
        tail = [f"own{i}x{j}" for j in range(44)]
        texts.append(passage + tail)
        texts.append(passage + [f"other{i}x{j}" if j in (12, 28, 43) else w for j, w in enumerate(tail)])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    assert all(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(sets), 2))
    assert len(sets[0] & sets[2]) < 0.8 * len(sets[0] | sets[2])
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def test_packing(docs, none):
    path = queries._tokenizer("byte_bpe_50k.json")
    packed = packing.pack(docs, path, 64)
    rows = packed.placed("doc_id", "piece", "start").collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
    assert sorted(len(r["ids"]) // 4 for r in packed.sequences().collect()) == sorted(sum(n for _, n in p) for p in bins.values())
    assert packing.pack(none, path, 64).placed("doc_id").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts(name):
    """Texts that spell an added token out get its id, as from plain ``encode``."""
    from array import array

    from tokenizers import Tokenizer

    from gazettemill.llm import tokens

    path = queries._tokenizer(name)
    texts = ["plain words", "one<|endoftext|>two", "<|startoftext|> Ä É<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "", "x <|endoftext|>\n" * 3, "last words", "é <|startoftext|>é " * 90_000]
    plain = Tokenizer.from_file(path)
    want = [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert tokens.PieceEncoder(path).encode(texts) == want


@pytest.mark.parametrize("counts,bins", [({6: 2, 4: 2}, 2), ({10: 3}, 3), ({7: 1, 3: 1, 5: 2}, 2), ({5: 3, 2: 2, 1: 1}, 2), ({}, 0)])
def test_packing_patterns(counts, bins):
    patterns = packing.pack_histogram(counts, 10)
    held = {}
    for content, times in patterns:
        assert sum(content) <= 10
        for s in content:
            held[s] = held.get(s, 0) + times
    assert held == counts and sum(m for _, m in patterns) == bins


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.flagged(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.flagged(none, labels).count() == 0
    assert {r["score"] for r in toxicity.flagged(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns(spark):
    clean = [(i, f"calm words about thing{i % 50} number{i} and nothing else") for i in range(400)]
    bad = [(1000 + i, f"you silly gronkwit{i % 5} number{i} thing{i % 50} words again") for i in range(80)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic"))
    got = toxicity.flagged(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] >= 1000) for r in got if r["held_out"])
    assert any(r["evidence"] for r in got)


def test_line_dedup(spark, docs, none):
    line = "A line that is certainly longer than forty characters, yes"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\nshort\n{line}") for i in range(6)] + [(5, f"own 5b\n{line}"), (6, "short\nshort"), (7, None)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(i, 4, 2, f"own {i}\nshort") for i in range(5)] + [(5, 4, 0, rows[5][1]), (5, 2, 0, rows[6][1]), (6, 2, 0, "short\nshort"), (7, 1, 0, "")])
    out = linededup.dedup_lines(docs)
    assert out.count() == len(TEXTS) and set(docs.columns) <= set(out.columns)
    assert {(r["doc"], r["body"], r["bitmap"]) for r in out.collect()} == {("user's doc", "user's body", "b")}
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_key_over_many_partitions(spark):
    line = "the very same line of more than forty characters in all"
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit("\n" + line)).alias("text"))
    got = linededup.dedup_lines(rows)
    assert got.where("n_dropped = 1").count() == 2999 and got.where("n_dropped = 0").select("doc_id").first()[0] == 2999


def test_main_text(spark):
    page = (
        '<html><head><title>T</title></head><body><header>top</header><div class="cookie-notice">cookies</div><nav>menu</nav>'
        '<article><h1>Head &amp; line</h1><p>First  para<br>goes on<p>Second<script>var a="<p>x</p>"</script></p><form>mail</form>'
        '<div class="comments"><p>me too</p></div><ul><li>one<li>two</ul></article><aside>side</aside><footer>f</footer></body>'
    )
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "odd", "plain < text"), (1, "http://a.example/x", page), (None, "http://b.example", "<p>lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("noise", F.lit(1))
    got = sorted((r["page_id"] or 0, r["text"]) for r in htmlmain.extract(pages).collect())
    want = "Head & line\nFirst para goes on\nSecond\none\ntwo"
    assert got == [(0, "lone"), (1, want), (1, want), (2, ""), (3, "plain < text")]
    assert htmlmain.extract(pages.limit(0)).count() == 0


def test_main_text_style_tree(spark):
    """A branch that all pages of a host share goes; what differs stays."""
    page = "<body><div class='a'><p>Always the same promise here</p></div><div class='b'><p>Story {0} tells {0}</p></div></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in htmlmain.extract(pages).collect()} == {f"Story {i} tells {i}" for i in range(30)}


def test_repeated_substrings(spark, docs, none):
    out = suffixdedup.dedup(docs)
    got = {(r["doc_id"], r["n_bytes"]): r for r in out.collect()}
    assert out.count() == len(TEXTS)
    assert got[1, 0]["n_spans"] == 0 and {(r["doc"], r["body"], r["spans"]) for r in got.values()} == {("user's doc", "user's body", "s")}
    nine = [r for (i, _), r in got.items() if i == 9][0]
    text = TEXTS[10][1]
    assert bytes(nine["kept"]).decode() == text.replace(" " + PASSAGE + " ", "") and nine["n_spans"] == 1
    assert suffixdedup.dedup(none).count() == 0


def test_suffix_array():
    import random

    draw = random.Random(1)
    for _ in range(1500):
        text = [draw.randint(1, draw.choice([1, 2, 3, 10])) for _ in range(draw.randint(0, 40))] * draw.choice([1, 1, 2, 3]) + [0]
        assert suffixdedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("crowd", [20_000, 50])
def test_repeated_substrings_in_a_crowd(spark, monkeypatch, crowd):
    """Many different contexts of an anchor, together and split by their windows' offsets."""
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() * 4 + passage + hashlib.sha1(str(i).encode()).hexdigest() * 5) for i in range(90)]
    got = suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [t.encode() for _, t in rows]
    from collections import Counter

    seen = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    for r in got:
        b = texts[r["doc_id"]]
        cover = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = [True] * 200
        assert bytes(r["kept"]) == bytes(x for x, c in zip(b, cover) if not c)


def test_piecewise(spark, docs, none):
    got = ctph.with_next(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (6, 7)}) == 1
    single = ctph.with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert single[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and single[0]["near_next"] == 1
    assert ctph.with_next(none).count() == 0


def test_secrets(spark, docs, none):
    live = "Zx9Qw8Er7Ty6Ui5Op4As3"
    copied = "Copied0Example1Value2Here3"
    rows = [(1, "a", f"TOKEN: abc def {live}"), (2, "b", f"api_key=xyz123 {copied}"), (3, "c", copied), (4, "d", f"é {copied}"), (5, None, None), (5, None, "secret: token: abcdefgh")]
    got = {(r["doc_id"], r["spans"]) for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, source string, text string"))).collect()}
    assert got == {(1, "owned:15:36"), (2, "assign:0:14"), (3, ""), (4, ""), (5, "")}
    assert secrets.scan(docs).count() == len(TEXTS) and secrets.scan(none).count() == 0


def test_decontamination(spark, docs, none):
    item = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "three word item"), (None, PASSAGE)], "item_id long, text string")
    rows = [(1, f"before {item.upper()} after"), (2, item.replace("word7 ", "")), (3, "Three, word item!"), (4, "a three word item"), (5, None), (1, f"before {item.upper()} after")]
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {g[:2] for g in got} == {(1, 1), (3, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == {(9, None), (10, None)}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench).count() == len(TEXTS) - 2


def test_decontamination_of_very_long_texts(spark):
    """Counts beyond 16 bits: an item and a document of 70 000 words."""
    words = [f"w{i % 977}q{i % 31}" for i in range(70_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c d e f g h i j")], "item_id long, text string")
    rows = [(1, "x y z " + " ".join(words)), (2, " ".join(words[:30_000]))]
    assert [tuple(r)[:2] for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()] == [(1, 1)]


def test_decontamination_finds_all_near_windows(spark):
    """Edited passages at and just above the threshold: the fingerprint index misses none of what the exact way finds."""
    import random
    from collections import Counter

    draw = random.Random(5)
    word = lambda: draw.choice("abcdefghij") + str(draw.randint(0, 300))
    items = [[word() for _ in range(draw.randint(12, 60))] for _ in range(40)]
    docs = []
    for i in range(400):
        text = list(draw.choice(items))
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = word()
        docs.append([word() for _ in range(draw.randint(0, 9))] + text + [word() for _ in range(draw.randint(0, 9))])
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            s, t = cut(text), Counter(cut(item))
            m = t.total()
            for a in range(len(s)):
                both = (Counter(s[a : a + m]) & t).total()
                if both / (m + len(s[a : a + m]) - both) >= 0.8:
                    want.add((d, k))
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    got = {tuple(r)[:2] for r in decontam.leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert len(want) > 150 and got == want


def test_token_files(spark, docs, none, tmp_path):
    path = queries._tokenizer("word_bpe_49k.json")
    files = tokenfiles.write(docs, f"file://{tmp_path}", path, 1)
    rows = sorted(files.read().collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert tokenfiles.write(none, f"file://{tmp_path}", path, 1).read().count() == 0


def test_similar_groups_meet_by_simhash(spark, monkeypatch):
    """Documents within two bits of a SimHash are among the pairs that are verified first; only similar ones become groups."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:399], "x"])), (3, " ".join(f"v{i}" for i in range(400)))]
    asked = []
    found = simhash._near_in_print
    monkeypatch.setattr(simhash, "_near_in_print", lambda prints: asked.append(found(prints).collect()) or found(prints))
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1} and len(asked) == 1
    prints = spark.createDataFrame([(5, 7), (6, 7), (9, 4), (8, ~7)], "doc_id long, fp long")
    assert {frozenset((r["x"], r["y"])) for r in found(prints).collect()} == {frozenset((5, 6)), frozenset((5, 9))}


def test_workers_give_up_what_other_stages_kept(spark):
    def held(owner: str | None):
        def run(batches):
            from gazettemill.llm import common, tokens

            if owner:
                common.take_over(owner)
            else:
                import public_tokenizers

                tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(["some words"])
            for _ in batches:
                import pandas as pd

                yield pd.DataFrame({"n": [len(common._kept)]})

        return spark.range(1, numPartitions=1).mapInPandas(run, "n int").collect()[0]["n"]

    assert [held(None), held("another stage"), held(None)] == [1, 0, 1]


def test_windows_are_made_of_common_bytes_only(spark, monkeypatch):
    """Contexts of a crowd whose ranges nobody shares go before their windows are counted one by one."""
    monkeypatch.setattr(suffixdedup, "CROWD", 50)
    made, cut = {}, suffixdedup.common.cut

    def counted(df, name):
        out = cut(df, name)
        made[name] = out.count() if name == "cases" else None
        return out

    monkeypatch.setattr(suffixdedup.common, "cut", counted)
    rows = [(i, hashlib.sha512(str(i).encode()).hexdigest() * 2 + "the passage of all " * 6 + hashlib.sha512(str(-i).encode()).hexdigest() * 2) for i in range(1, 81)]
    assert all(r["n_removed"] == 0 for r in suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert made["cases"] == 0


def test_windows_are_joined_once(spark, monkeypatch):
    """No join that sets large keys apart, and so passes its left rows again, gets all windows of a crowd's cases."""
    monkeypatch.setattr(suffixdedup, "CROWD", 50)
    passed, join = [], suffixdedup.common.weighted_join

    def counted(left, right, keys, *rest):
        passed.append(left.count() if keys == ["h1", "h2"] else 0)
        return join(left, right, keys, *rest)

    monkeypatch.setattr(suffixdedup.common, "weighted_join", counted)
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() * 4 + passage + hashlib.sha1(str(i).encode()).hexdigest() * 5) for i in range(60)]
    got = suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed"] >= 260 for r in got)
    whole = 60 * (128 // suffixdedup.SPLIT + 1)  # every context in every range
    assert 0 < max(passed) <= whole


def test_repeated_substrings_broadcast_nothing_that_grows(spark, monkeypatch):
    """Windows of a crowd come from an explode, spans and wanted places lie in arrays: Spark sizes them too low, so it may not choose."""
    monkeypatch.setattr(suffixdedup, "CROWD", 50)
    plans, write = {}, suffixdedup.common.write

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(suffixdedup.common, "write", seen)
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() * 4 + passage + hashlib.sha1(str(i).encode()).hexdigest() * 5) for i in range(90)]
    done = suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    plans["result"] = done._jdf.queryExecution().executedPlan().toString()
    assert {"again", "counted", "contexts", "joint", "told", "found", "spans", "result"} <= set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
    assert sum(r["n_removed"] > 0 for r in done.collect()) == 90

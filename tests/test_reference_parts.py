"""Parsers, dictionaries, stores and the map against plain Python on literal rows."""

import datetime as dt
import html
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazettemill.functions import blocks, tokens
from gazettemill.operators import dedup, lexical, signals, spectral
from gazettemill.plans import views
from gazettemill.sources import feeds
from gazettemill.sources.signal_store import SignalStore


def test_character_references_as_the_standard_has_them(spark):
    rng = random.Random(3)
    odd = ["&eacute;", "&#233;", "&#x41;", "&#X1F600;", "&amp;lt;", "&ampx", "&notit;", "&notin;", "&AMP", "&#128;", "&#0;", "&#xD800;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFF;", "&nosuch;", "&", "&;", "&#;", "&#x;", "a & b", "&CounterClockwiseContourIntegral;", "&nbsp", "&#11;", "&#13;", "&#150;x", "&copy2;", "&NotEqualTilde;", "", None]
    names = [*tokens.NAMED, *tokens.BARE]
    texts = odd + ["".join(rng.choice(["&" + rng.choice(names), f"&#{rng.randrange(0, 0x11FFFF)}" + rng.choice(["", ";"]), "x", " ", "&", ";", "1"]) for _ in range(6)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.unescape(F.col("t")).alias("u")).collect()
    for row in rows:
        want = None if texts[row["i"]] is None else html.unescape(texts[row["i"]])
        assert row["u"] == want, texts[row["i"]]


def test_media_and_authors_of_feeds(spark, tmp_path):
    head = '<rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'
    items = [
        '<media:content url="http://e.org/big.jpg" medium="image"/><media:thumbnail url="http://e.org/small.jpg"/><dc:creator> Ann </dc:creator><dc:creator>Bob</dc:creator>',
        '<media:thumbnail url="http://e.org/t.jpg"/><author>Cy</author>',
        '<enclosure url="http://e.org/a.mp3" type="audio/mpeg"/><enclosure url="http://e.org/e.png" type="image/png"/>',
        '<media:group><media:content url="http://e.org/g.jpg"/></media:group>', "",
    ]
    (tmp_path / "f.xml").write_text(head + "".join(f"<item><title>T{i} &amp;eacute; &amp;#8217;</title><link>http://e.org/{i}</link>{x}</item>" for i, x in enumerate(items)) + "</channel></rss>")
    got = {r["url"][-1]: (r["title"], r["image"], r["authors"]) for r in feeds.rss_items(spark, str(tmp_path)).collect()}
    base = "http://e.org/"
    assert got == {"0": ("T0 é ’", base + "big.jpg", ["Ann", "Bob"]), "1": ("T1 é ’", base + "t.jpg", ["Cy"]), "2": ("T2 é ’", base + "e.png", None), "3": ("T3 é ’", base + "g.jpg", None), "4": ("T4 é ’", None, None)}


def test_trust_markup_of_any_depth(spark):
    block = lambda x: f"<script async type='application/ld+json'>{json.dumps(x)}</script>"
    deep = {"@type": "Organization", "noBylinesPolicy": "http://x.org/n", "name": "Deep"}
    for _ in range(6):
        deep = {"@type": "WebPage", "publisher": [[deep]]}
    rows = {
        "deep": block(deep), "paper": block({"@type": "Newspaper", "ethicsPolicy": ["", {"name": "http://x.org/e"}]}), "media": block({"@type": "MediaObject", "ethicsPolicy": "http://x.org/e"}),
        "part": block({"@type": "MyOrganization", "masthead": "http://x.org/m"}), "invented": block({"@type": ["Thing", "CORPORATION"], "missionCoveragePrioritiesPolicy": "http://x.org/c", "name": [" Acme "], "foundingDate": "1901"}),
        "source": block({"@type": "Article", "sourceOrganization": {"@type": "NewsMediaOrganization", "correctionsPolicy": {"url": "see http://x.org"}, "masthead": {"@id": "https://x.org/m"}, "parentOrganization": {"@type": "Corporation", "name": "Holding"}}}),
        "broken": "<script type='application/ld+json'>{</script>", "none": None,
    }
    got = {r["domain"]: (r["commitments"], r["score"], r["name"], r["founded"], r["publisher"]) for r in feeds.trust_markup(spark.createDataFrame(list(rows.items()), "domain string, html string")).collect()}
    nothing = (None, 0, None, None, None)
    assert got == {"deep": (["noBylinesPolicy"], 1, "Deep", None, None), "paper": (["ethicsPolicy"], 1, None, None, None), "media": nothing, "part": nothing, "invented": (None, 0, "Acme", "1901", None), "source": (["masthead"], 1, "Holding", None, "Holding"), "broken": nothing, "none": nothing}


LONG = "One of the long sentences that an article has, with more than eight words in it."


@pytest.mark.parametrize("page,want", [
    (f'<nav><a href="/">Home of the site with very many links here today</a></nav><article><h1>Title</h1><p class="x">{LONG} <a href="u">link</a> <b>bold</b></p><p>{LONG}</article><footer>{LONG}</footer>', ["Title", f"{LONG} link bold", LONG]),
    (f"<div><p>{LONG}<ul><li>first point</li><li>second <i>point</i></li></ul><p>{LONG}</div>", [LONG, "first point", "second point", LONG]),
    (f"<main><blockquote><p>Short quote.</p></blockquote><p>{LONG}</p></main><div>{LONG}</div>", ["Short quote.", LONG]),
    (f'<div class="post tags-intro"><p class="share-price">{LONG}</p></div><div hidden><p>{LONG}</p></div><div class="comments"><p>{LONG}</p></div>', []),
    (f'<div class="tags"><p class="price">{LONG}</p></div><p hidden>{LONG}</p>', [LONG]),
    (f"<script>var a='<p>{LONG}</p>'</script><p>{LONG} caf&eacute; &#8217;<br>next line</p>", [f"{LONG} café ’ next line"]),
    ("<p>too short</p>", []), ("", []), ("<b>" * 3000 + f"<p>{LONG}", [LONG]),
])
def test_main_text_blocks(page, want):
    if "share-price" in page:  # a class that names a part beside the text decides for its block
        want = []
    assert blocks.main_text(page) == want


def test_every_paragraph_of_an_article_stays(spark, sf):
    rows = views.page(spark, sf).select("html", blocks.main_blocks(F.col("html")).alias("b")).collect()
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split())
    for row in rows:
        article = re.search(r"(?s)<article>(.*)</article>", row["html"]).group(1)
        assert list(row["b"]) == [t for t in map(plain, re.split(r"</?(?:p|h1|ul|li)[^>]*>", article)) if t]


def kept_by_rule(rows, distance, limit):
    kept, out = {}, {}
    for i, outlet, fp in sorted(rows):
        recent = kept.setdefault(outlet, [])
        out[i] = all((fp ^ old).bit_count() > distance for old in recent[-limit:])
        if out[i]:
            recent.append(fp)
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 400])
def test_only_the_latest_kept_prints_count(spark, slice_rows):
    """Print 0 comes again after 299 and after 300 other kept ones: known the first time, new the second."""
    rng = random.Random(5)
    spread = [rng.getrandbits(63) for _ in range(700)]
    one = [(i, "a", fp) for i, fp in enumerate([0, *spread[:299], 1, spread[299], 3, *spread[300:500]])]
    two = [(1000 + i, "b", rng.choice(spread[:40]) ^ (1 << rng.randrange(60))) for i in range(300)]
    want = kept_by_rule(one + two, 3, 300)
    assert not want[300] and want[302]
    got = {r["article_id"]: r["kept"] for r in dedup.keep_recent(spark.createDataFrame(one + two, "article_id long, outlet string, fp long"), 3, 300, slice_rows).collect()}
    assert got == want


def test_trie_against_patterns(spark):
    rng = random.Random(2)
    words = "tassa tasse tasso casa case casi rosa rose di un la tax taxes flat".split()
    terms = [("g", "flat tax"), ("g", "tassa"), ("h", "la casa di rosa"), ("h", "casa"), ("h", "di di"), ("g", "un"), ("h", "Flat  Tax")]
    texts = [rng.choice(["", " ", "¡"]) + "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ", ", "-", "_"]) for _ in range(rng.randrange(60))) for _ in range(150)] + ["di di di di", "La Casa di Rosa", "", None]
    pattern = lambda term: re.compile(r"(?<!\w)(?:" + r"\s+".join("(?:" + "|".join(map(re.escape, sorted(lexical.variants(w)))) + ")" for w in term.lower().split()) + r")(?!\w)", re.I)
    want = {(i, g, t, n) for i, text in enumerate(texts) for g, t in terms if (n := len(pattern(t).findall(text or "")))}
    articles = spark.createDataFrame([(i, "o", "it", t) for i, t in enumerate(texts)] + [(999, "o", "xx", "tassa")], "article_id long, outlet string, language string, full_text string")
    frames = spark.createDataFrame([("it", g, t) for g, t in terms], "lang string, grp string, term string")
    assert {(r["article_id"], r["grp"], r["term"], r["n"]) for r in lexical.frame_counts(articles, frames).collect()} == want


def test_signal_store_keeps_history(spark, tmp_path):
    store = SignalStore(spark, f"{tmp_path}/store")
    assert store.read().count() == 0
    run = lambda week, *rows: spark.createDataFrame([(o, t, a, dt.date(2024, 1, week), dt.date(2024, 1, week + 6), v) for o, t, a, v in rows], "outlet string, type string, axis string, period_start date, period_end date, value string")
    store.write(run(1, ("x", "tone", None, "1"), ("y", "tone", None, "2"), ("x", "annotation", "econ", "3")), "m1")
    store.write(run(8, ("x", "tone", None, "4")), "m1")
    store.write(run(1, ("x", "tone", None, "5"), ("z", "tone", None, "6"), ("x", "annotation", "culture", "7")), "m2")
    got = sorted((r["outlet"], r["type"], r["axis"] or "", r["period_start"].day, r["value"], r["method"]) for r in store.read().collect())
    assert got == [("x", "annotation", "culture", 1, "7", "m2"), ("x", "annotation", "econ", 1, "3", "m1"), ("x", "tone", "", 1, "5", "m2"), ("x", "tone", "", 8, "4", "m1"), ("y", "tone", "", 1, "2", "m1"), ("z", "tone", "", 1, "6", "m2")]
    store.write(run(15, *[]), "m3")
    assert store.read().count() == 6


def _by_svd(pairs):
    rows, columns = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    m = np.zeros((len(rows), len(columns)))
    for a, b in pairs:
        m[rows.index(a), columns.index(b)] = 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m -= m.mean(axis=0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    q = u[:, :2] * s[:2]
    return dict(zip(rows, q * np.sign(q[np.abs(q).argmax(axis=0), [0, 1]]))), s[:2] ** 2 / (s**2).sum()


def test_map_against_svd(spark, sf):
    c = views.cov(spark, sf)
    want, shares = _by_svd([tuple(r) for r in signals.cocoverage_pairs(c).select("outlet_id", "story_id").collect()])
    got = signals.cocoverage_map(c).collect()
    assert len(got) == len(want) and (got[0]["variance_x"], got[0]["variance_y"]) == tuple(np.round(shares, 3))
    assert max(np.abs(want[r["outlet_id"]] - (r["x"], r["y"])).max() for r in got) < 1.0001e-4 / 2 + 1e-6


def test_axes_of_more_rows_than_the_basis(spark):
    """300 rows, a basis of 96: the iteration starts again from its best until the residuals are small."""
    rng = np.random.default_rng(4)
    pairs = sorted({(int(i), int(s)) for i in range(300) for s in rng.integers(0, 60, 12) + (i % 3) * 40})
    want, shares = _by_svd(pairs)
    placed, told = spectral.principal_coordinates(spark.createDataFrame(pairs, "outlet_id long, story_id long"), tolerance=1e-7)
    got = {r["outlet_id"]: np.array(r["coordinates"]) for r in placed.collect()}
    assert max(np.abs(got[i] - want[i]).max() for i in want) < 5e-5 and np.allclose(told, shares, atol=1e-6)


def test_landed_dictionaries(spark, tmp_path):
    from gazettemill.sources import dictionaries

    land = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)
    topics = dictionaries.topics(spark, land("t.json", {"version": 1, "topics": [
        {"id": "politics", "keywords": {"en": ["Prime Minister's office", "parliament vote", " "], "it": ["governo"]}}, {"id": "elections", "keywords": {"en": ["ballot", "exit poll", "ballot"]}}]}))
    assert sorted((r["topic"], r["ordinal"], r["lang"], r["term"], r["total"]) for r in topics.collect()) == [
        ("elections", 1, "en", "ballot", 2), ("elections", 1, "en", "exit poll", 2), ("politics", 0, "en", "parliament vote", 2), ("politics", 0, "en", "prime minister's office", 2), ("politics", 0, "it", "governo", 1)]
    texts = [(1, "en", "The PRIME MINISTER'S OFFICE on the ballots"), (2, "en", "exit poll: a ballot"), (3, "fr", "a Parliament Vote"), (4, "it", "il governo, il ballot"), (5, "en", "parliament  vote"), (6, "en", None), (7, "en", "")]
    rows = spark.createDataFrame(texts, "article_id long, language string, full_text string")
    assert sorted((r["article_id"], r["topic"], r["score"]) for r in lexical.topic_scores(rows, topics).collect()) == [(1, "politics", 0.5), (2, "elections", 1.0), (3, "politics", 0.5), (4, "politics", 1.0)]
    frames = dictionaries.frames(spark, land("f.json", {"language": "en", "groups": [{"id": "migration", "terms": [{"term": "illegal alien", "connotation": "negative"}, {"term": " migrant "}, {"term": ""}]}]}))
    assert sorted((r["lang"], r["grp"], r["term"], r["connotation"], r["n_tokens"]) for r in frames.collect()) == [("en", "migration", "illegal alien", "negative", 2), ("en", "migration", "migrant", "neutral", 1)]
    valence = dictionaries.valence(spark, land("v.json", {"language": "en", "valence": {"Crisis": -1.5, "good": 1}}))
    assert sorted(map(tuple, valence.collect())) == [("en", "crisis", -1.5), ("en", "good", 1.0)]
    stops = dictionaries.stop_words(spark, land("s.json", {"language": "en", "words": ["The", "of", "the"]}))
    assert sorted(map(tuple, stops.collect())) == [("en", "of"), ("en", "the")]


def test_language_by_script_then_by_words(spark):
    stops = spark.createDataFrame([("en", "the"), ("en", "of"), ("fr", "le"), ("fr", "de")], "stop_lang string, word string")
    texts = ["the end of the day 2024", "le jour de la fin", "Новости дня", "the le", "", None, "1 2 3", "ニュースの the"]
    rows = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "article_id long, language string, full_text string")
    got = {r["article_id"]: (r["detected"], None if r["confidence"] is None else round(r["confidence"], 6)) for r in lexical.detect_language(rows, stops).collect()}
    nothing = (None, None)
    assert got == {0: ("en", 0.99), 1: ("fr", 0.99), 2: ("ru", 0.5), 3: nothing, 4: nothing, 5: nothing, 6: nothing, 7: ("ja", 0.9)}


def test_roles_of_phrases():
    assert lexical.role_of("The Prime Minister said") == "government" and lexical.role_of("its chief executive and manager") == "company"
    assert lexical.role_of("a chief of an executive board") is None and lexical.role_of("UNITED NATIONS") == "institution"


def test_positions_against_numpy(spark):
    from gazettemill.operators import positioning

    rng = np.random.default_rng(1)
    x = rng.normal(size=(230, 5))
    y = x @ [1, -2, 0, 0.5, 3] + rng.normal(size=230) + 4
    rows = [(i, "econ", f"o{i % 3}", [float(v) for v in x[i]], float(y[i])) for i in range(230)] + [(i, "few", "o0", [0.0] * 5, 1.0) for i in range(199)] + [(500, "econ", "o0", None, 1.0)]
    table = spark.createDataFrame(rows, "article_id long, axis string, outlet string, features array<double>, label double")
    models = positioning.fit(table)

    def ridge(a, b):
        centre = a.mean(axis=0)
        w = np.linalg.solve((a - centre).T @ (a - centre) + np.eye(5), (a - centre).T @ (b - b.mean()))
        return np.concatenate([[b.mean() - centre @ w], w])

    fold = {r["article_id"]: r["f"] for r in table.select("article_id", F.pmod(F.xxhash64("article_id"), F.lit(5)).alias("f")).collect()}
    folds = np.array([fold[i] for i in range(230)])
    errors = []
    for k in range(5):
        w = ridge(x[folds != k], y[folds != k])
        errors.append(np.abs(w[0] + x[folds == k] @ w[1:] - y[folds == k]).mean())
    assert list(models) == ["econ"] and models["econ"]["n"] == 230 and np.isclose(models["econ"]["mae"], np.mean(errors))
    want = ridge(x, y)
    assert np.allclose(models["econ"]["weights"], want)
    got = {r["outlet"]: (r["articles"], r["position"], r["examples"]) for r in positioning.outlet_positions(table.where("axis = 'econ'"), models).collect()}
    for o in range(3):
        at = np.arange(230) % 3 == o
        assert got[f"o{o}"][0] == at.sum() and np.isclose(got[f"o{o}"][1], (want[0] + x[at] @ want[1:]).mean()) and got[f"o{o}"][2] == 230


def test_loadings_and_canvas_against_svd(spark, sf):
    c = views.cov(spark, sf)
    pairs = [tuple(r) for r in signals.cocoverage_pairs(c).select("outlet_id", "story_id").collect()]
    rows, columns = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    m = np.zeros((len(rows), len(columns)))
    for a, b in pairs:
        m[rows.index(a), columns.index(b)] = 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m -= m.mean(axis=0)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    signs = np.sign((u[:, :2] * s[:2])[np.abs(u[:, :2]).argmax(axis=0), [0, 1]])
    loads = signals.map_loadings(c, 10).collect()
    for axis in (0, 1):
        told = sorted(r["loading"] for r in loads if r["axis"] == axis)
        mine = np.sort(vt[axis] * signs[axis] / s[axis])
        scale = max(abs(mine[0]), abs(mine[-1]))
        assert len(told) == 20 and np.allclose(np.array(told) / max(map(abs, told)), np.concatenate([mine[:10], mine[-10:]]) / scale, atol=2e-3)


def test_a_run_of_feed_items(spark):
    text = lambda i: " ".join(f"word{i}_{k}" for k in range(30))
    stored = spark.createDataFrame([(1, "a", "http://e.org/1?utm_source=x", "Old", ""), (2, "a", "http://e.org/2", "Two", text(2)), (3, "b", "http://b.org/1", "B", text(9))], "article_id long, outlet string, url string, title string, snippet string")
    items = [
        ("a", 0, "http://e.org/1", "New title", "s"), ("a", 1, "http://e.org/2", "Two again", text(2)), ("a", 2, "http://e.org/3", "Two", text(2)), ("a", 3, "http://e.org/4", "Four", text(4)),
        ("a", 4, "http://e.org/4#top", "Four", text(4)), ("a", 5, "http://e.org/5", "Four", text(4)), ("b", 0, "http://b.org/2", "Two", text(2)), ("c", 0, "http://c.org/1", "C", None), ("a", 6, "http://e.org/1", "Old", "s"),
    ]
    got = dedup.ingest(spark.createDataFrame(items, "outlet string, place long, url string, title string, snippet string"), stored)
    assert {(r["outlet"], r["place"]): (r["status"], r["retitled"]) for r in got.collect()} == {
        ("a", 0): ("existing", True), ("a", 1): ("existing", False), ("a", 2): ("duplicate", False), ("a", 3): ("created", False), ("a", 4): ("existing", False),
        ("a", 5): ("duplicate", False), ("b", 0): ("created", False), ("c", 0): ("created", False), ("a", 6): ("existing", False)}
    assert sorted(map(tuple, dedup.ingest_counts(got).collect())) == [("a", 7, 1, 4, 2, 1), ("b", 1, 1, 0, 0, 0), ("c", 1, 1, 0, 0, 0)]
    guesses = spark.createDataFrame([("a", 3, "en"), ("b", 0, None)], "outlet string, place long, detected string")
    told = dedup.with_language(got, guesses, spark.createDataFrame([("a", "it"), ("b", "de")], "outlet string, language string"))
    assert {(r["outlet"], r["place"]): r["language"] for r in told.collect() if r["status"] == "created"} == {("a", 3): "en", ("b", 0): "de", ("c", 0): None}


def test_own_links_of_verified_accounts(spark):
    cards = spark.createDataFrame([("@Paper", "https://www.paper.example/1"), ("paper", "https://news.paper.example/2"), ("paper", "https://notpaper.example/3"), ("other", "https://other.example/4"), ("nobody", "https://paper.example/5")], "handle string, url string")
    accounts = spark.createDataFrame([("paper", "www.Paper.example", True), ("other", "other.example", False)], "handle string, domain string, verified boolean")
    assert sorted(r["url"][-1] for r in dedup.own_links(cards, accounts).collect()) == ["1", "2"]


def test_versions_far_apart_on_the_map(spark):
    from gazettemill.operators import coverage

    rows = spark.createDataFrame([(1, o, 10 + o, "it", "it", dt.datetime(2024, 1, 1, o)) for o in range(4)], "story_id long, outlet_id long, article_id long, country string, language string, published_at timestamp")
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 1.0, 1.0), (3, 0.0, 0.8)], "outlet_id long, x double, y double")
    assert tuple(coverage.diverse_versions(rows, places).first()) == (1, 10, 12, 13)
    assert tuple(coverage.diverse_versions(rows, places.where("outlet_id <> 2")).first()) == (1, 10, 13, 11)  # no place: same country and language
    assert tuple(coverage.diverse_versions(rows).first()) == (1, 10, 11, 12)


def test_subtitles(spark):
    from gazettemill.operators import coverage

    stories = spark.createDataFrame([(1, "Governo vara piano", "it", {"en": "Made"}), (2, "Governo vara piano", "it", {}), (3, "Government acts", "en", {"en": "x"}), (4, "piano", None, None), (5, "Governo vara piano", "it", {"en": ""})], "story long, title_neutral string, title_language string, translations map<string,string>")
    at = lambda d: dt.datetime(2024, 1, d)
    articles = [
        (2, 1, "Other Topic Entirely", "s", "en", "en", at(1)), (2, 2, "Government plan", "", "en", "en", at(2)), (2, 3, "The Governor speaks", "s", "en", "en", at(4)), (2, 4, "Government early", "s", "en", "no", at(1)),
        (4, 5, "small plan", None, "en", "en", at(1)), (5, 6, "Governo vara piano", "s", "en", "en", at(1)),
    ]
    rows = spark.createDataFrame(articles, "story long, article_id long, title string, snippet string, language string, outlet_language string, published_at timestamp")
    got = {r["story"]: (r["subtitle"], r["translated"]) for r in coverage.headline_subtitles(stories, rows, "en").collect()}
    assert got == {1: ("Made", True), 2: ("The Governor speaks", False), 3: (None, False), 4: ("small plan", False), 5: (None, False)}


def test_views_of_the_latest_signals(spark):
    rows = [
        ("x", "agenda", None, 1, {"a": 0.9}), ("x", "agenda", None, 8, {"a": 0.05, "b": -0.0312, "c": 0.01, "d": 0.0, "e": -0.2}), ("x", "tone", None, 8, {"negative": 1, "neutral": 2, "positive": 0}),
        ("x", "framing", None, 8, {"g/t1": 2, "g/t2": 3, "h/t": 1}), ("x", "annotation", "econ", 1, {"label": 0.5, "published": True, "missing": ""}), ("x", "annotation", "cult", 8, {"published": False, "missing": "articles"}), ("y", "tone", None, 1, {"negative": 0, "neutral": 0, "positive": 0}),
    ]
    stored = spark.createDataFrame([(o, t, a, dt.date(2024, 1, w), dt.date(2024, 1, w + 6), json.dumps(v)) for o, t, a, w, v in rows], "outlet string, type string, axis string, period_start date, period_end date, value string")
    got = sorted((r["outlet"], r["view"], r["axis"] or "", r["place"] or 0, r["item"], r["value"]) for r in signals.signal_views(stored).collect())
    assert got == sorted([
        ("x", "agenda over", "", 1, "a", 5.0), ("x", "agenda over", "", 2, "c", 1.0), ("x", "agenda over", "", 3, "d", 0.0), ("x", "agenda under", "", 1, "e", -20.0), ("x", "agenda under", "", 2, "b", -3.1), ("x", "agenda under", "", 3, "d", 0.0),
        ("x", "tone", "", 1, "neutral", 67.0), ("x", "tone", "", 2, "negative", 33.0), ("x", "tone", "", 3, "positive", 0.0), ("y", "tone", "", 1, "negative", 0.0), ("y", "tone", "", 2, "neutral", 0.0), ("y", "tone", "", 3, "positive", 0.0),
        ("x", "framing", "", 1, "g", 5.0), ("x", "framing", "", 2, "h", 1.0), ("x", "annotation", "econ", 0, "label", 0.5), ("x", "annotation", "econ", 0, "published", 1.0), ("x", "annotation", "cult", 0, "published", 0.0),
    ])


def test_rules_on_prints_hash_each_text_once(spark):
    """Greedy, recent and per-outlet rules read prints several times, but what makes them runs once for each row."""
    hashed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for pdf in batches:
            hashed.add(len(pdf))
            yield pdf

    rows = [(i, "ab"[i % 2], (i * 0x9E3779B97F4A7C15) % (1 << 63) if i % 5 else 7) for i in range(40)]
    shape = "article_id long, outlet string, fp long"
    for turn, rule in enumerate((dedup.greedy_keep, dedup.repeats_in_outlet, lambda p: dedup.keep_recent(p, 3, 300, 10)), 1):
        rule(spark.createDataFrame(rows, shape).mapInPandas(counting, shape)).collect()
        assert hashed.value == len(rows) * turn


def test_axes_of_few_rows_take_one_product(spark, monkeypatch):
    """Up to ``_BASIS`` rows are spanned at once: the pairs are joined for one product, not one a round."""
    rng = np.random.default_rng(5)
    pairs = sorted({(int(i), int(s)) for i in range(40) for s in rng.integers(0, 90, 15)})
    want, shares = _by_svd(pairs)
    steps, products = [], spectral._products
    monkeypatch.setattr(spectral, "_products", lambda *a: steps.append(a[1:]) or products(*a))
    placed, told = spectral.principal_coordinates(spark.createDataFrame(pairs, "outlet_id long, story_id long"))
    got = {r["outlet_id"]: np.array(r["coordinates"]) for r in placed.collect()}
    assert [s for s in steps if s != ("both", "both")] == [("z", "z")]
    assert max(np.abs(got[i] - want[i]).max() for i in want) < 1e-8 and np.allclose(told, shares, atol=1e-9)

"""Operators on literal rows: parsers, repairs, folds, upserts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gazettemill.functions import tokens
from gazettemill.operators import annotation, coverage, dedup, lexical, signals, stories, vectors
from gazettemill.sources import feeds
from gazettemill.streaming import arrivals


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTPS://User@Ex.ORG:443/A?b=2&a=1&utm_source=x#f", "https://ex.org/A?a=1&b=2"), ("http://e.org", "http://e.org/"), ("http://e.org/?flag&q=a%20b", "http://e.org/?flag=&q=a+b"),
    ("e.org/p?fbclid=1", "https://e.org/p"), ("http://e.org:8080/x", "http://e.org:8080/x"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, tokens.canonical_url(F.col("u")), u=url) == want


def test_titles_and_snippets(spark):
    assert one(spark, tokens.tidy_title(F.col("t")), t="united states says 9 / 11 , ( now )  ok") == "USA says 9/11, (now) ok"
    assert one(spark, tokens.snippet(F.col("t")), t="<p>Tom &amp; Ann</p>  <b>x</b>") == "Tom & Ann x"
    long = one(spark, tokens.snippet(F.col("t")), t="word " * 100)
    assert len(long) <= 200 and long.endswith("word…")
    assert one(spark, tokens.strip_think(F.col("t")), t="  <think>a\nb</think>\n\nText <think>c</think>") == "Text <think>c</think>"
    assert one(spark, tokens.strip_think(F.col("t")), t="<think>never closed") == ""
    assert one(spark, tokens.strong_words(F.col("t")), t="Governo vara 2026 piano da 150 Ann") == ["150", "governo"]
    assert one(spark, tokens.same_news(F.array(F.lit("governo")), F.array(F.lit("government"))), t="") is True


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title> A &amp;amp; B </title><link>http://e.org/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>d</pubDate><author>X</author></item>"
        "<item><title></title><link>http://e.org/2</link></item></channel></rss>"
    )
    rows = feeds.rss_items(spark, str(tmp_path)).collect()
    assert [(r["url"], r["title"], r["snippet"], r["authors"]) for r in rows] == [("http://e.org/1", "A & B", "Hi", ["X"])]


def test_catalogue_and_sinks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"slug": "a", "name": "A", "feed_urls": ["u"], "motto": "m"}\n{"slug": "b", "enabled": false, "region": "eu"}\n{"name": "no slug"}\n')
    rows = {r["slug"]: r for r in feeds.catalogue(spark, f"{tmp_path}/c.jsonl").collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["feed_urls"] == ["u"] and rows["a"]["extra"] == {"motto": "m"} and rows["a"]["region"] == "world" and rows["a"]["enabled"]
    assert (rows["b"]["enabled"], rows["b"]["region"], rows["b"]["feed_urls"]) == (False, "eu", [])
    table = spark.createDataFrame([(1, "x,y")], "id int, t string")
    feeds.write_csv(table, f"{tmp_path}/csv")
    feeds.write_jsonl(table, f"{tmp_path}/jsonl")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["t"] == "x,y" and spark.read.json(f"{tmp_path}/jsonl").first()["id"] == 1


def test_search_and_social(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"articles": [{"url": "u", "title": "a , b", "seendate": "20240102T030405Z", "socialimage": "", "language": "German"}, {"url": "v", "title": ""}]}))
    (row,) = feeds.search_articles(spark, f"{tmp_path}/s.json").collect()
    assert (row["title"], row["image"], row["language"], row["seen"]) == ("a, b", None, "de", dt.datetime(2024, 1, 2, 3, 4, 5))
    card = {"uri": "http://e.org/a", "title": "T", "description": "D"}
    posts = [{"post": {"uri": "at://x/app/k1", "record": {"createdAt": "c"}, "embed": {"$type": "external", "external": card}}}, {"reason": {"$type": "repost"}, "post": {"uri": "y", "embed": {"external": card}}}, {"post": {"uri": "z"}}]
    (tmp_path / "b.json").write_text(json.dumps({"feed": posts}))
    assert [r["post_url"] for r in feeds.bluesky_links(spark, f"{tmp_path}/b.json", "me").collect()] == ["https://bsky.app/profile/me/post/k1"]
    (tmp_path / "m.json").write_text(json.dumps([{"url": "p1", "card": {"url": "http://e.org", "title": "t"}}, {"url": "p2", "card": None}]))
    assert [r["post_url"] for r in feeds.mastodon_links(spark, f"{tmp_path}/m.json").collect()] == ["p1"]


def test_small_parsers(spark):
    for name, code in ((" KOREAN ", "ko"), ("Dutch", "nl"), ("Klingon", None)):
        assert one(spark, feeds.language_code(F.col("t")), t=name) == code
    assert one(spark, feeds.compact_time(F.col("t")), t="bad") is None
    assert one(spark, F.struct(*feeds.account_parts(F.col("u"))), u="https://mas.to/@ann") == ("mas.to", "ann")
    assert one(spark, feeds.first_image(F.lit(""), F.col("t"), F.lit("e")), t="thumb") == "thumb"
    for text, want in (("Привет, мы были", ("ru", 0.9)), ("Привіт її", ("uk", 0.9)), ("и так", ("ru", 0.5)), ("hello", (None, None)), ("日本のニュースだよ", ("ja", 0.9)), ("新闻", ("zh", 0.7)), ("γειά ok", ("el", 0.9)), ("한국", ("ko", 0.9)), ("हिन्दी", ("hi", 0.8)), ("12 !", (None, None))):
        assert one(spark, lexical.script_guess(F.col("t")), t=text)[1:] == want, text


def test_ads_and_trust(spark):
    ads = spark.createDataFrame([("d.org", "# c\ncontact=x\nGoogle.com, pub-1, DIRECT, f0\ngoogle.com, pub-1, direct\nshort, line\nx.com, 2, reseller # y")], "domain string, text string")
    assert sorted((r["exchange"], r["account"], r["relation"]) for r in feeds.ads_lines(ads).collect()) == [("google.com", "pub-1", "direct"), ("x.com", "2", "reseller")]
    block = json.dumps({"@graph": [{"@type": "NewsMediaOrganization", "ethicsPolicy": "https://d.org/e", "masthead": {"@id": "http://d.org/m"}, "diversityPolicy": "soon"}]})
    pages = spark.createDataFrame([("d.org", f'<script type="application/ld+json">{block}</script>'), ("e.org", "<p>")], "domain string, html string")
    assert {r["domain"]: (r["commitments"], r["score"]) for r in feeds.trust_markup(pages).collect()} == {"d.org": (["ethicsPolicy", "masthead"], 2), "e.org": (None, 0)}
    shared = feeds.public_profile(pages.select("domain"), feeds.ads_lines(ads), feeds.trust_markup(pages), spark.createDataFrame([("d.org", dt.datetime(2020, 1, 2))], "domain string, ts timestamp"))
    assert {r["domain"]: (r["networks"], r["direct"], r["lines"], r["score"]) for r in shared.collect()} == {"d.org": (2, 1, 2, 2), "e.org": (None, None, None, 0)}


def test_claims(spark):
    claim = lambda q, year: {"mainsnak": {"datavalue": {"value": {"id": q}}}, "qualifiers": {"P580": [{"datavalue": {"value": {"time": year}}}]}}
    raw = json.dumps({"P127": [claim(f"Q{i}", f"+{1990 + i}-01-01T00:00:00Z") for i in range(10)], "P999": [claim("Q1", "+2000")]})
    facts = feeds.claims(spark.createDataFrame([("E", raw)], "entity string, claims string"), spark.createDataFrame([("P127",)], "property string"))
    labels = spark.createDataFrame([("Q0", None, "Zero"), ("Q1", "Uno", "One")], "id string, it string, en string")
    rows = {r["target"]: (r["label"], r["from_year"], r["to_year"]) for r in feeds.labelled(facts, labels).collect()}
    assert len(rows) == 8 and rows["Q0"] == ("Zero", 1990, None) and rows["Q1"] == ("Uno", 1991, None) and rows["Q2"] == ("Q2", 1992, None)
    assert len(feeds.owner_facts(feeds.labelled(facts, labels)).first()["facts"]) == 8


def test_upserts(spark):
    schema = "outlet_id int, type string, axis string, period_end string, value int"
    old = spark.createDataFrame([(1, "tone", None, "p1", 1), (1, "tone", None, "p2", 2), (1, "tone", "x", "p2", 3)], schema)
    new = spark.createDataFrame([(1, "tone", None, "p2", 9)], schema)
    assert sorted(r["value"] for r in feeds.replace_signals(old, new).collect()) == [1, 3, 9]
    cols = "url string, title string, snippet string, image string"
    stored = spark.createDataFrame([("a", "old", "", None), ("b", "old", "has", None), ("c", "same", "", None)], cols)
    fresh = spark.createDataFrame([("a", "new", "s", "i"), ("b", "new", "s", "i"), ("c", "same", "s", "i")], cols)
    assert {r["url"]: (r["title"], r["snippet"], r["image"], r["retitled"]) for r in feeds.retitle(stored, fresh).collect()} == {"a": ("new", "s", "i", True), "b": ("old", "has", None, False), "c": ("same", "", None, False)}
    articles = spark.createDataFrame([(1, "a , b"), (2, "a , b")], "article_id long, title string")
    prov = spark.createDataFrame([(1, "search"), (1, "search"), (2, "feed")], "entity_id long, method string")
    assert {r["article_id"]: r["title"] for r in feeds.backfill_titles(articles, prov, "search").collect()} == {1: "a, b", 2: "a , b"}
    kept = feeds.carry_entity_ids(*(spark.createDataFrame(r, s) for r, s in (([("s", "A"), ("s", "B"), ("s", "C")], "story string, label string"), ([("s", "A", "Q1")], "story string, label string, qid string"), ([("A", "Q9", 1), ("B", "Q2", 2), ("B", "Q3", 1)], "label string, qid string, rank int"))))
    assert {r["label"]: r["qid"] for r in kept.collect()} == {"A": "Q1", "B": "Q3", "C": None}
    stories = spark.createDataFrame([("s", "T", {"fr": "x"}, {"en": "sum"})], "story string, title string, translations map<string,string>, summaries map<string,string>")
    made = spark.createDataFrame([("s", "fr", "y"), ("s", "de", "T"), ("s", "es", "Z")], "story string, locale string, text string")
    assert feeds.merge_translations(stories, made).first()["translations"] == {"fr": "x", "de": "", "es": "Z"}
    assert tuple(feeds.summary_for(stories, "it", ["en"]).first()) == ("s", "sum", False)


def test_agreement(spark):
    rate = lambda rows: spark.createDataFrame([("o", "x", a, u, v, 0.0) for a, u, v in rows], "outlet string, axis string, article_id int, annotator_id int, value int, self_axis double")
    alpha = lambda rows: annotation.agreement(rate(rows)).first()["alpha"]
    assert alpha([(i, u, i % 3 - 1) for i in range(9) for u in range(3)]) == 1.0
    assert alpha([(i, u, (-2, 2)[u % 2]) for i in range(9) for u in range(2)]) < 0.2
    assert alpha([(1, 1, 1), (2, 2, 0)]) is None
    assert alpha([(1, 1, 1), (1, 2, 1)]) == 1.0


def test_citations_and_variants(spark):
    found = lexical.citations('«Non ci fermeremo mai più», ha detto Mario Rossi, ministro. Jane Doe says no. According to Jane Doe yes.')
    assert [(c["speaker"], c["role"]) for c in found][0] == ("Mario Rossi", "government") and {c["speaker"] for c in found} == {"Mario Rossi", "Jane Doe"}
    assert found[0]["quote"] == "Non ci fermeremo mai più"
    terms = spark.createDataFrame([("ricco",), ("rosa",), ("due",)], "term string")
    assert sorted(r["variant"] for r in lexical.word_variants(terms).collect()) == ["due", "ricci", "ricco", "riccos", "rosa", "rosas", "rose"]


def test_words_of_speaking_are_the_references():
    """Of English and Italian verbs only those of the reference make a speaker."""
    assert lexical.citations("Thathe stated the rest.") == [] and lexical.citations("Jane Doe argued so.") == []
    for text in ("Jane Doe claims so.", "Jane Doe declared war.", "Mario Rossi ribadisce il no.", "«Non ci fermeremo», avverte Mario Rossi."):
        assert [c["speaker"] for c in lexical.citations(text)] in (["Jane Doe"], ["Mario Rossi"])


def test_citations_by_grammar(spark):
    found = {c["speaker"]: c for c in lexical.citations('Yesterday Prof Anna Bianchi, told "short" us. Laut Minister Karl Ott, “this is a long quotation”. In Rome the mayor said no.')}
    assert set(found) == {"Karl Ott"} or set(found) == {"Karl Ott", "Anna Bianchi"}
    assert found["Karl Ott"]["role"] == "government" and found["Karl Ott"]["quote"] == "this is a long quotation"
    assert lexical.citations("") == [] and lexical.role_of("nothing at all") is None
    titles = spark.createDataFrame([(1, 1, "Today Angela Merkel met Emmanuel Macron, Paris says"), (1, 2, "Talks: Angela Merkel and others"), (2, 3, "A visit of Olaf Scholz to New York City Hall Square")], "story long, article_id long, title string")
    assert sorted((r["story"], r["label"], r["n"]) for r in lexical.story_entities(titles).collect()) == [(2, "New York City Hall", 1), (2, "Olaf Scholz", 1)]


def test_fingerprint_of_a_very_long_text(spark):
    from gazettemill.operators import dedup

    long = " ".join(f"w{i % 313}" for i in range(100_000))
    rows = spark.createDataFrame([(1, "a", long), (2, "a", long + " end"), (3, "b", "")], "article_id long, outlet string, full_text string")
    prints = dedup.simhash(rows)
    assert dedup.near_pairs(prints).where("a = 1 and b = 2").count() + prints.where("article_id < 3").select("fp").distinct().count() in (1, 3)


def test_story_fold():
    import numpy as np

    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert vectors.fold_stories([(0, a), (1, a), (2, b), (80, a), (81, b)], 0.5) == [0, 0, 1, 2, 3]


def test_small_map_is_empty(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "outlet_id long, country long, story_id long")
    assert signals.cocoverage_map(rows).count() == 0


def test_late_split(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "article_id long, published_at timestamp")
    fresh, late = arrivals.split_late(rows, F.lit(dt.datetime(2024, 1, 5)))
    assert [r["article_id"] for r in fresh.collect()] == [2] and [r["article_id"] for r in late.collect()] == [1]


def test_atom_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><title>T</title><link rel="self" href="http://e.org/self"/><link rel="alternate" href="http://e.org/1"/><summary>S</summary><published>p</published><updated>u</updated><author><name>Ann</name></author></entry>'
        '<entry><title>U</title><link href="http://e.org/2"/><updated>u</updated></entry><entry><title>V</title></entry></feed>'
    )
    rows = feeds.rss_items(spark, str(tmp_path), "entry").collect()
    assert [(r["url"], r["title"], r["snippet"], r["published"], r["authors"]) for r in rows] == [("http://e.org/1", "T", "S", "p", ["Ann"]), ("http://e.org/2", "U", "", "u", None)]


def test_labelled_pairs(spark, tmp_path):
    rows = [{"id": "1", "title_a": "a", "title_b": "b", "same_story": True, "cross_language": True}, {"id": "2", "title_a": "a", "title_b": "c", "same_story": False}, {"id": "3", "title_a": "a"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted((r["id"], r["same_story"], r["cross_language"]) for r in feeds.labelled_pairs(spark, f"{tmp_path}/p.json").collect()) == [("1", True, True), ("2", False, False)]


def test_front_page_falls_back_to_the_latest(spark):
    seen = spark.createDataFrame([(s, 1, dt.datetime(2024, 1, s)) for s in (1, 2, 3)], "story long, outlet_id long, published_at timestamp")
    page = lambda day: {r["story"] for r in coverage.top_stories(seen, F.lit(dt.datetime(2024, 1, day)), "story", 2).collect()}
    assert page(4) == {2, 3} and page(30) == {2, 3} and coverage.top_stories(seen.limit(0), F.lit(dt.datetime(2024, 1, 4)), "story", 2).count() == 0


def test_story_topics(spark):
    stories = spark.createDataFrame([(1, "Money"), (2, "nothing")], "story long, title_neutral string")
    members = spark.createDataFrame([(1, 1, "the vote", "en"), (1, 2, "geld", "de"), (1, 3, None, "en"), (2, 4, "x", None)] + [(2, i, "y", "en") for i in range(5, 12)] + [(2, 12, "vote", "en")], "story long, article_id long, title string, language string")
    topics = spark.createDataFrame([("economy", 0, "en", "money", 1), ("politics", 1, "en", "vote", 2), ("economy", 0, "de", "geld", 1)], "topic string, ordinal int, lang string, term string, total int")
    rows = lexical.story_topics(stories, members, topics).collect()
    assert sorted((r["story"], r["topic"], r["score"], r["place"]) for r in rows) == [(1, "economy", 1.0, 1), (1, "politics", 0.5, 2)]


def test_greedy_keep_decides_in_order(spark):
    chain = [(i, "o", v) for i, v in enumerate([0, 0b111, 0b111111, 0b111111111, 0, 1 << 40])] + [(9, "p", 0)]
    kept = dedup.greedy_keep(spark.createDataFrame(chain, "article_id long, outlet string, fp long"))
    assert sorted(r["article_id"] for r in kept.where("kept").collect()) == [0, 2, 9]
    assert sorted(r["article_id"] for r in kept.where("not kept").collect()) == [1, 3, 4, 5]


def test_stories_do_not_live_across_a_gap(spark):
    rows = [(1, 0.0, [1.0, 0.0]), (2, 10.0, [1.0, 0.1]), (3, 90.0, [1.0, 0.0]), (4, 91.0, [0.0, 1.0])]
    got = {r["article_id"]: r["story"] for r in stories.assign_stories(spark.createDataFrame(rows, "article_id long, t double, embedding array<double>"), slice_rows=2).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}


def test_feed_links(spark):
    html = """<head><link rel="alternate" type="application/rss+xml" href="/feed?a=1&amp;b=2"><LINK TYPE='application/atom+xml' HREF='//cdn.example/atom' REL='alternate home'>
    <link rel="alternate" type="application/rss+xml" href="local.xml"/><link rel=alternate type=application/rss+xml href=ftp://x/feed><link rel="stylesheet" href="/s.css"><link rel="alternate" hreflang="it" href="/it"></head>"""
    got = feeds.feed_links(spark.createDataFrame([("https://a.example/news/today?x", html), ("https://b.example", html), (None, None)], "url string, html string")).collect()
    assert {(r["url"], r["feed"]) for r in got} == {
        ("https://a.example/news/today?x", f) for f in ("https://a.example/feed?a=1&b=2", "https://cdn.example/atom", "https://a.example/news/local.xml")
    } | {("https://b.example", f) for f in ("https://b.example/feed?a=1&b=2", "https://cdn.example/atom", "https://b.example/local.xml")}


def test_trust_markup_below_other_nodes(spark):
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    graph = """{"@graph": [{"@type": "WebPage", "ethicsPolicy": "https://no.example"}, {"@type": "Article", "publisher": {"@type": ["NewsMediaOrganization"],
     "ethicsPolicy": {"@id": "https://x.example/e"}, "masthead": ["none", {"url": "http://x.example/m"}], "diversityPolicy": "none",
     "parentOrganization": {"@type": "Organization", "ownershipFundingInfo": "https://x.example/o"}}}]}"""
    rows = [("graph", block(graph)), ("list", block('[{"@type": "Organization", "correctionsPolicy": "https://y.example"}]')), ("broken", block("{")), ("none", None)]
    got = {r["domain"]: (r["commitments"], r["score"]) for r in feeds.trust_markup(spark.createDataFrame(rows, "domain string, html string")).collect()}
    # A list tells what its first member tells: the masthead says "none", which is no address.
    assert got == {"graph": (["ethicsPolicy", "ownershipFundingInfo"], 2), "list": (["correctionsPolicy"], 1), "broken": (None, 0), "none": (None, 0)}


def test_only_texts_with_a_word_for_speaking_reach_python(spark):
    texts = ["Jane Doe says no.", "nobody speaks here", "ACCORDING to Jane Doe", "Jane Doe SAID", "Secondo Mario Rossi", "unsaidly", "Jean Dupont déclaré", None]
    rows = spark.createDataFrame([(i, "o", t) for i, t in enumerate(texts)], "article_id long, outlet string, full_text string")
    found = lexical.cited_speakers(rows)
    assert "RLIKE" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, c["speaker"]) for i, t in enumerate(texts) for c in lexical.citations(t or "")}
    assert len(want) == 5 and {(r["article_id"], r["speaker"]) for r in found.collect()} == want


def test_batches_of_texts_are_bounded(spark):
    """Frames and topics hand whole texts to Python in small batches."""
    from gazettemill.functions import dims

    rows = spark.createDataFrame([(1, "o", "en", "of the heat")], "article_id long, outlet string, language string, full_text string")
    for call in (lambda: lexical.frame_counts(rows, dims.frames(spark)), lambda: lexical.topic_scores(rows, dims.topics(spark))):
        for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{name}")
        call()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"


def test_language_and_features_shuffle_nothing(spark):
    from gazettemill.functions import dims
    from gazettemill.operators import vectors

    rows = spark.createDataFrame([(1, None, "the cat and the dog of it"), (2, None, "Приве: the of it"), (3, None, "12"), (4, None, None), (5, None, "“αβγδ” the")], "article_id long, language string, full_text string")
    told = lexical.detect_language(rows, dims.stop_words(spark))
    assert {r["article_id"]: r["detected"] for r in told.collect()} == {1: "en", 2: "en", 3: None, 4: None, 5: "el"}
    for out in (told, vectors.hashed_features(rows, dims.stop_words(spark), "full_text")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()

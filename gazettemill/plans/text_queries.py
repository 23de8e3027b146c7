"""Queries on documents, pages and embeddings with their DuckDB twins."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as blocks_of
from ..functions import dims
from ..functions import tokens as T
from ..operators import annotation, dedup, lexical, positioning, signals, stories, vectors
from ..session import shared_dir
from ..sources import feeds
from ..sources.signal_store import SignalStore
from . import coverage_queries as cq
from . import views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_CTES = views.SQL | dims.SQL


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            head = ", ".join(f"{n} AS ({_CTES[n]})" for n in uses)
            body = sql.strip()
            ORACLE[name] = f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
        return f

    return add


DOC, PAGE, EMB = ("doc",), ("page",), ("emb",)
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _words(column: str) -> str:
    return _WORDS.format(column)


_TRACK = "(" + ",".join(f"'{x}'" for x in T.TRACKING_NAMES) + ")"
_CANON = rf"""u0 AS (SELECT page_id, url, regexp_replace(trim(url),'#.*$','') AS u FROM page), u1 AS (SELECT *, lower(regexp_extract(u,'^([A-Za-z][A-Za-z0-9+.-]*)://',1)) AS sc, regexp_replace(u,'^[A-Za-z][A-Za-z0-9+.-]*://','') AS rs FROM u0),
 u2 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rs,'^([^/?]*)',1)),'^[^@]*@',''),':(80|443)?$','') AS h, regexp_extract(rs,'^[^/?]*(/[^?]*)?',1) AS pa, regexp_extract(rs,'\?(.*)$',1) AS q FROM u1),
 u3 AS (SELECT page_id, url, h, sc, pa, (SELECT string_agg(kv, '&' ORDER BY kv) FROM (SELECT unnest(string_split(q,'&')) AS kv) WHERE kv<>'' AND lower(split_part(kv,'=',1)) NOT IN {_TRACK} AND NOT regexp_matches(lower(kv),'^(mtm_|piwik_|pk_|utm_)')) AS qs FROM u2),
 cu AS (SELECT page_id, url, (CASE WHEN sc='' THEN 'https' ELSE sc END)||'://'||h||(CASE WHEN coalesce(pa,'')='' THEN '/' ELSE pa END)||coalesce('?'||qs,'') AS canonical FROM u3)"""


@query("e1_canonical_url", f"WITH {_CANON} SELECT page_id, canonical FROM cu", PAGE)
def e1(spark, d):
    return views.page(spark, d).select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


#: The references that the given pages hold, for DuckDB, which knows none.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _unescaped(column: str) -> str:
    for name, char in _ENTITIES.items():
        column = f"replace({column}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return column


@query("e2_snippet", rf"""WITH t AS (SELECT page_id, trim(regexp_replace({_unescaped("regexp_replace(html,'<[^>]*>',' ','g')")},'\s+',' ','g')) AS t FROM page)
 SELECT page_id, CASE WHEN length(t)<=200 THEN t WHEN contains(substr(t,1,199),' ') THEN regexp_extract(substr(t,1,199),'^(.*) ',1)||'…' ELSE substr(t,1,199)||'…' END AS snippet FROM t""", PAGE)  # fmt: skip
def e2(spark, d):
    return views.page(spark, d).select("page_id", T.snippet(F.col("html")).alias("snippet"))


@query("e3_title", rf"""SELECT page_id, trim(regexp_replace({_unescaped("regexp_extract(html,'<title>([^<]*)</title>',1)")},'\s+',' ','g')) AS title FROM page""", PAGE)
def e3(spark, d):
    raw = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return views.page(spark, d).select("page_id", F.trim(F.regexp_replace(T.unescape(raw), r"\s+", " ")).alias("title"))


@query("e4_tidy_title", r"""SELECT article_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(title,'\s+([,.;:!?%)\]])','\1','g'),'([(\[])\s+','\1','g'),'\s{2,}',' ','g'))) AS title FROM doc""", DOC)
def e4(spark, d):
    return views.doc(spark, d).select("article_id", F.md5(T.tidy_title(F.col("title"))).alias("title"))


@query("e7_paragraphs", rf"""WITH b AS (SELECT page_id, unnest(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1|ul|li)[^>]*>')) AS b FROM page),
 t AS (SELECT page_id, row_number() OVER () AS k, trim(regexp_replace({_unescaped("regexp_replace(b, '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS t FROM b)
 SELECT page_id, count(*) AS paragraphs, md5(string_agg(t, chr(10) ORDER BY k)) AS text FROM t WHERE t<>'' GROUP BY 1""", PAGE)  # fmt: skip
def e7(spark, d):
    blocks = F.transform(blocks_of.main_blocks(F.col("html")), lambda b: F.trim(b))
    return views.page(spark, d).select("page_id", blocks.alias("b")).select("page_id", F.size("b").cast("long").alias("paragraphs"), F.md5(F.array_join("b", "\n")).alias("text"))


@query("e8_feed_links", r"""WITH t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*>')) AS tag FROM page)
 SELECT DISTINCT url, regexp_extract(tag, 'href="(https?://[^"]*)"', 1) AS feed FROM t WHERE regexp_matches(tag, '(?i)rel="alternate"') AND regexp_matches(tag, '(?i)type="application/(rss|atom)\+xml"')""", PAGE)  # fmt: skip
def e8_feeds(spark, d):
    """The feeds that pages declare; the given pages declare none, so tests on literal pages carry this one."""
    return feeds.feed_links(views.page(spark, d).select("url", "html"))


@query("e8_outlinks", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM page", PAGE)
def e8(spark, d):
    return views.page(spark, d).select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))


@query("e13_language", rf"""WITH w AS (SELECT article_id, unnest(regexp_extract_all(lower(full_text), '{lexical.LETTERS}')) AS word FROM doc), n AS (SELECT article_id, count(*) AS total FROM w GROUP BY 1),
 s AS (SELECT article_id, stop_lang, count(*) AS hits FROM w JOIN stops USING(word) GROUP BY 1,2), r AS (SELECT article_id, stop_lang, hits/total::DOUBLE AS share, row_number() OVER (PARTITION BY article_id ORDER BY hits/total::DOUBLE DESC, stop_lang DESC) AS rn FROM s JOIN n USING(article_id)),
 b AS (SELECT a.article_id, a.stop_lang AS detected, least(0.99, 3*a.share) AS confidence FROM r a LEFT JOIN r c ON c.article_id=a.article_id AND c.rn=2 WHERE a.rn=1 AND a.share>=0.10 AND a.share-coalesce(c.share,0)>=0.02)
 SELECT article_id, language, detected, round(confidence,6) AS confidence FROM doc LEFT JOIN b USING(article_id)""", ("doc", "stops"))  # fmt: skip
def e13(spark, d):
    return lexical.detect_language(views.doc(spark, d), dims.stop_words(spark)).withColumn("confidence", F.round("confidence", 6))


_STRONG = r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title,'[\p{L}\p{N}_]+'), lambda t: (regexp_matches(t,'^\p{Lu}') AND length(t)>=4) OR (regexp_matches(t,'^[0-9]{2,}$') AND NOT regexp_matches(t,'^(19|20)[0-9][0-9]$'))), lambda t: lower(t))))"


@query("e15_strong_words", f"SELECT article_id, array_to_string({_STRONG}, ' ') AS strong FROM doc", DOC)
def e15(spark, d):
    return views.doc(spark, d).select("article_id", F.array_join(T.strong_words(F.col("title")), " ").alias("strong"))


_PAIRS = f"""wl AS (SELECT article_id, {_words("full_text")} AS w FROM doc), sg AS (SELECT article_id, unnest(list_transform(range(1, greatest(len(w),1)), lambda i: w[i]||' '||w[i+1])) AS s FROM wl)"""
_SIMHASH = (
    _PAIRS
    + ", hh AS (SELECT article_id, ('0x'||substr(md5(s),1,8))::BIGINT AS hi, ('0x'||substr(md5(s),9,8))::BIGINT AS lo FROM sg), bt AS (SELECT article_id, count(*) AS n, "
    + ", ".join(f"sum((hi>>{i})&1) AS h{i}, sum((lo>>{i})&1) AS l{i}" for i in range(32))
    + " FROM hh GROUP BY 1), sh AS (SELECT doc.article_id, doc.outlet, coalesce("
    + "+".join(f"(CASE WHEN 2*h{i}>n THEN {1 << i} ELSE 0 END)" for i in range(32))
    + ",0)::BIGINT AS hi, coalesce("
    + "+".join(f"(CASE WHEN 2*l{i}>n THEN {1 << i} ELSE 0 END)" for i in range(32))
    + ",0)::BIGINT AS lo FROM doc LEFT JOIN bt ON bt.article_id=doc.article_id)"
)


@query("d1_simhash", f"WITH {_SIMHASH} SELECT article_id, printf('%08x%08x', hi, lo) AS simhash FROM sh", DOC)
def d1(spark, d):
    return dedup.simhash(views.doc(spark, d)).select("article_id", dedup.hexadecimal("fp").alias("simhash"))


_NEAR = "cl AS (SELECT hi, lo, min(article_id) AS id FROM sh GROUP BY 1,2)"


@query("d2_near_pairs", f"WITH {_SIMHASH}, {_NEAR} SELECT x.id AS a, y.id AS b, (bit_count(xor(x.hi,y.hi))+bit_count(xor(x.lo,y.lo)))::INT AS distance FROM cl x JOIN cl y ON x.id<y.id WHERE bit_count(xor(x.hi,y.hi))+bit_count(xor(x.lo,y.lo))<=3", DOC)
def d2(spark, d):
    return dedup.near_pairs(dedup.simhash(views.doc(spark, d)))


@query("d4_latest_prints", "SELECT article_id, outlet FROM (SELECT article_id, outlet, row_number() OVER (PARTITION BY outlet ORDER BY article_id DESC) AS rn FROM doc) WHERE rn<=300", DOC)
def d4(spark, d):
    return dedup.latest_prints(views.doc(spark, d).select("article_id", "outlet"), 300)


@query("d5_repeats_in_outlet", f"""WITH {_SIMHASH}, co AS (SELECT outlet, hi, lo, min(article_id) AS id FROM sh GROUP BY 1,2,3)
 SELECT DISTINCT article_id, outlet FROM (SELECT s.article_id, s.outlet FROM sh s JOIN co c ON c.outlet=s.outlet AND c.hi=s.hi AND c.lo=s.lo WHERE s.article_id>c.id
 UNION ALL SELECT y.id, y.outlet FROM co x JOIN co y ON x.outlet=y.outlet AND x.id<y.id WHERE bit_count(xor(x.hi,y.hi))+bit_count(xor(x.lo,y.lo))<=3)""", DOC)  # fmt: skip
def d5(spark, d):
    return dedup.repeats_in_outlet(dedup.simhash(views.doc(spark, d)))


@query("d8_ingest_counts")
def d8_counts(spark, d):
    """A run that brings every document as a feed item of its outlet, into a store that holds the first half of them."""
    a = views.doc(spark, d).withColumn("url", F.concat(F.lit("https://"), "outlet", F.lit(".example/"), F.col("article_id").cast("string")))
    half = a.agg(F.floor(F.max("article_id") / 2)).first()[0]
    return dedup.ingest_counts(dedup.ingest(a.withColumnRenamed("article_id", "place"), a.where(F.col("article_id") <= half)))


@query("d5_recent_keep")
def d5_recent(spark, d):
    """The sequential rule against the 300 latest kept prints of an outlet, in slices of the table."""
    return dedup.keep_recent(dedup.simhash(views.doc(spark, d)), distance=3, limit=300)


@query("d5_greedy_keep")
def d5_greedy(spark, d):
    return dedup.greedy_keep(dedup.simhash(views.doc(spark, d)))


@query("d3_unknown_urls", f"""WITH {_CANON}, nw AS (SELECT * FROM cu WHERE page_id%5<>0), old AS (SELECT * FROM cu WHERE page_id%5=0)
 SELECT min(page_id) AS page_id, canonical FROM nw WHERE url NOT IN (SELECT url FROM old) AND canonical NOT IN (SELECT canonical FROM old) GROUP BY 2""", PAGE)  # fmt: skip
def d3(spark, d):
    p = views.page(spark, d).select("page_id", "url")
    return dedup.unknown(p.where("page_id % 5 <> 0"), p.where("page_id % 5 = 0")).select("page_id", "canonical")


_HOST = r"regexp_replace(lower(regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)',1)),'^www\.','')"


@query("d7_outlet_domains", f"""WITH h AS (SELECT page_id, {_HOST} AS h FROM page), o AS (SELECT DISTINCT h AS domain FROM h WHERE len(string_split(h,'.'))=3)
 SELECT page_id, arg_max(domain, length(domain)) AS domain FROM h JOIN o ON h.h=domain OR ends_with(h.h,'.'||domain) GROUP BY 1""", PAGE)  # fmt: skip
def d7(spark, d):
    p = views.page(spark, d)
    bare = F.regexp_replace(T.host(F.col("url")), r"^www\.", "")
    outlets = p.select(bare.alias("domain")).where(F.size(F.split("domain", r"\.")) == 3).distinct()
    return dedup.attribute(p, outlets)


@query("d8_ingest_funnel", f"""WITH {_CANON}, nw AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS rn FROM cu WHERE page_id%5<>0), old AS (SELECT * FROM cu WHERE page_id%5=0)
 SELECT CASE WHEN canonical IN (SELECT canonical FROM old) THEN 'existing' WHEN rn>1 THEN 'duplicate' ELSE 'created' END AS status, count(*) AS n FROM nw GROUP BY 1""", PAGE)  # fmt: skip
def d8(spark, d):
    p = views.page(spark, d).select("page_id", T.canonical_url(F.col("url")).alias("canonical"))
    old = p.where("page_id % 5 = 0").select("canonical").distinct().withColumn("known", F.lit(True))
    new = p.where("page_id % 5 <> 0").withColumn("rn", F.row_number().over(Window.partitionBy("canonical").orderBy("page_id"))).join(old, "canonical", "left")
    status = F.when(F.col("known"), "existing").when(F.col("rn") > 1, "duplicate").otherwise("created")
    return new.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("c1_hashed_features", rf"""WITH sl AS (SELECT list(word) AS sw FROM stops), ww AS (SELECT article_id, list_filter({_words("title")}, lambda x: NOT list_contains(sw, x)) AS w FROM doc, sl), jj AS (SELECT article_id, w, array_to_string(w,' ') AS j FROM ww WHERE len(w)>0),
 ft AS (SELECT article_id, 'w:'||unnest(w) AS f FROM jj UNION ALL SELECT article_id, 'c:'||substr(j, i, 4) FROM jj, unnest(range(1, length(j)-2)) t(i) UNION ALL SELECT article_id, 'c:'||substr(j, i, 5) FROM jj, unnest(range(1, length(j)-3)) t(i)),
 tf AS (SELECT article_id, f, 1+ln(count(*)) AS w FROM ft GROUP BY 1,2), hs AS (SELECT article_id, ('0x'||substr(md5(f),1,8))::BIGINT%768 AS idx, sum(w*CASE WHEN ('0x'||substr(md5(f),9,8))::BIGINT%2=0 THEN 1 ELSE -1 END) AS w FROM tf GROUP BY 1,2),
 nm AS (SELECT article_id, idx, w, sqrt(sum(w*w) OVER (PARTITION BY article_id)) AS norm FROM hs) SELECT article_id, idx, round(w/norm,6)+0.0 AS weight FROM nm WHERE norm>0""", ("doc", "stops"))  # fmt: skip
def c1(spark, d):
    return vectors.hashed_features(views.doc(spark, d), dims.stop_words(spark)).select("article_id", "idx", (F.round("weight", 6) + 0.0).alias("weight"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])/(sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[])))"


@query("c2_cosine", f"SELECT a.vec_id, round({_COS},6)+0.0 AS cosine FROM emb a JOIN emb b ON b.vec_id=a.vec_id+1", EMB)
def c2(spark, d):
    e = views.emb(spark, d)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", (F.round(T.cosine(F.col("embedding"), F.col("other")), 6) + 0.0).alias("cosine"))


@query("c3_neighbours", f"""SELECT query, vec_id, cosine, rank FROM (SELECT a.vec_id AS query, b.vec_id, round({_COS},5)+0.0 AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS},9) DESC, b.vec_id) AS rank
 FROM emb a JOIN emb b ON a.vec_id%20=0 AND a.vec_id<>b.vec_id) WHERE rank<=5""", EMB)  # fmt: skip
def c3(spark, d):
    e = views.emb(spark, d)
    return vectors.neighbours(e, e.where("vec_id % 20 = 0")).select("query", "vec_id", (F.round("cosine", 5) + 0.0).alias("cosine"), "rank")


_CENT = "x AS (SELECT label, unnest(range(0,len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM emb), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1,2), ce AS (SELECT label, pos, m/nullif(sqrt(sum(m*m) OVER (PARTITION BY label)),0) AS value FROM m)"


@query("c6_centroids", f"WITH {_CENT} SELECT label, pos, round(coalesce(value,0),6)+0.0 AS value FROM ce", EMB)
def c6(spark, d):
    return vectors.centroids(views.emb(spark, d)).select("label", "pos", (F.round("value", 6) + 0.0).alias("value"))


@query("c9_title_member", f"""WITH {_CENT}, cl AS (SELECT label, list(value ORDER BY pos) AS c FROM ce GROUP BY 1), s AS (SELECT emb.label, vec_id, coalesce(length(snippet)>100, false) AS told, round(list_dot_product(embedding::DOUBLE[], c)/sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[])),6) AS cos FROM emb JOIN cl USING(label) LEFT JOIN doc ON article_id=vec_id)
 SELECT label, vec_id, cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY told DESC, cos DESC, vec_id) AS rn FROM s) WHERE rn=1""", ("emb", "doc"))  # fmt: skip
def c9(spark, d):
    """Titles of label groups; every given document has a snippet, so one of over 100 characters stands for having one."""
    told = views.doc(spark, d).select(F.col("article_id").alias("vec_id"), (F.length("snippet") > 100).alias("told"))
    return vectors.nearest_to_centroid(views.emb(spark, d).join(told, "vec_id", "left"), preferred="told")


@query("c11_threshold_sweep", f"""WITH p AS (SELECT {_COS} AS c, a.label=b.label AS same FROM emb a JOIN emb b ON b.vec_id>a.vec_id), t AS (SELECT i*5/100.0 AS threshold FROM range(1,20) r(i)),
 s AS (SELECT threshold, count(*) FILTER (c>=threshold AND same) AS tp, count(*) FILTER (c>=threshold AND NOT same) AS fp, count(*) FILTER (c<threshold AND same) AS fn FROM p, t GROUP BY 1),
 r AS (SELECT *, CASE WHEN tp+fp=0 THEN 1.0 ELSE tp/(tp+fp)::DOUBLE END AS pr, CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn)::DOUBLE END AS rc FROM s)
 SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(pr,6)::DOUBLE AS precision, round(rc,6)::DOUBLE AS recall, round(CASE WHEN pr+rc=0 THEN 0 ELSE 2*pr*rc/(pr+rc) END,6)::DOUBLE AS f1 FROM r""", EMB)  # fmt: skip
def c11(spark, d):
    return vectors.sweep_all(views.emb(spark, d))


@query("c4_story_assignment")
def c4(spark, d):
    """Embeddings with the times of events, in order of time; a story is open for 72 hours after its last article."""
    timed = views.arr(spark, d).select("article_id", (F.unix_micros("published_at") / 3.6e9).alias("t"), "embedding")
    return stories.assign_stories(timed, threshold=0.18, window_hours=72)


_TOPIC = f"""tm AS (SELECT DISTINCT article_id, CASE WHEN language IN (SELECT lang FROM topics) THEN language ELSE 'en' END AS lang, unnest({_words("full_text")}) AS term FROM doc),
 ts AS (SELECT article_id, topic, ordinal, round(count(*)/first(total)::DOUBLE,4) AS score FROM tm JOIN topics USING(lang, term) GROUP BY 1,2,3)"""


@query("n1_topic_scores", f"WITH {_TOPIC} SELECT article_id, topic, score FROM ts", ("doc", "topics"))
def n1(spark, d):
    return lexical.topic_scores(views.doc(spark, d), dims.topics(spark)).select("article_id", "topic", "score")


@query("n2_primary_topic", f"WITH {_TOPIC} SELECT article_id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ordinal) AS rn FROM ts) WHERE rn=1", ("doc", "topics"))
def n2(spark, d):
    return lexical.primary_topic(lexical.topic_scores(views.doc(spark, d), dims.topics(spark)))


_STORY = f"""fm AS (SELECT * FROM (SELECT article_id//12 AS story, article_id, title, language, row_number() OVER (PARTITION BY article_id//12 ORDER BY article_id) AS nth FROM doc) WHERE nth<=8),
 nt AS (SELECT article_id//12 AS story, arg_max(title, length(snippet)*1000000000-article_id) AS title_neutral FROM doc GROUP BY 1),
 ln AS (SELECT story, language, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, language) AS rn FROM fm WHERE language IS NOT NULL GROUP BY 1,2),
 tx AS (SELECT story, concat_ws('. ', first(title_neutral), string_agg(coalesce(title,''), '. ' ORDER BY nth)) AS text FROM fm JOIN nt USING(story) GROUP BY 1),
 sw AS (SELECT DISTINCT tx.story, CASE WHEN language IN (SELECT lang FROM topics) THEN language ELSE 'en' END AS lang, unnest({_words("text")}) AS term FROM tx LEFT JOIN ln ON ln.story=tx.story AND rn=1),
 st AS (SELECT story, topic, ordinal, round(count(*)/first(total)::DOUBLE,4) AS score FROM sw JOIN topics USING(lang, term) GROUP BY 1,2,3)"""


@query("n2_story_topics", f"WITH {_STORY} SELECT story, topic, score, place FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY score DESC, ordinal) AS place FROM st) WHERE place<=3", ("doc", "topics"))
def n2_stories(spark, d):
    told = views.doc(spark, d).withColumn("story", F.expr("article_id div 12"))
    stories = told.groupBy("story").agg(F.max_by("title", F.struct(F.length("snippet").alias("n"), (-F.col("article_id")).alias("back"))).alias("title_neutral"))
    return lexical.story_topics(stories, told.select("story", "article_id", "title", "language"), dims.topics(spark))


_FORMS = sorted({(lang, grp, term, " ".join(form)) for grp, lang, term in dims.FRAMES for form in itertools.product(*(lexical.variants(w) for w in term.split()))})
_FRAME = rf"""fk AS (SELECT article_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (SELECT article_id, regexp_extract_all(lower(full_text), '{T.TOKEN}') AS w FROM doc)), fm AS (SELECT * FROM (VALUES {dims._values(_FORMS)}) t(lang, grp, term, form)),
 gm AS (SELECT article_id, tok AS form FROM fk UNION ALL SELECT article_id, tok||' '||lead(tok) OVER (PARTITION BY article_id ORDER BY pos) FROM fk),
 fc AS (SELECT doc.article_id, outlet, grp, term, count(*) AS n FROM gm JOIN doc USING(article_id) JOIN fm ON lang=language AND fm.form=gm.form GROUP BY 1,2,3,4)"""


@query("n4_frame_counts", f"WITH {_FRAME} SELECT article_id, outlet, grp, term, n FROM fc", ("doc", "frames"))
def n4(spark, d):
    return lexical.frame_counts(views.doc(spark, d), dims.frames(spark))


@query("b12_outlet_framing", f"WITH {_FRAME} SELECT outlet, grp, term, sum(n)::BIGINT AS n FROM fc WHERE outlet IN (SELECT outlet FROM doc GROUP BY 1 HAVING count(*)>=5) GROUP BY 1,2,3", ("doc", "frames"))
def b12(spark, d):
    a = views.doc(spark, d)
    return lexical.outlet_framing(lexical.frame_counts(a, dims.frames(spark)), a)


_TONE = f"""tw AS (SELECT article_id, CASE WHEN language IN (SELECT lang FROM valence) THEN language ELSE 'en' END AS lang, unnest({_words("title")}) AS word FROM doc), tv AS (SELECT article_id, round(avg(score),4) AS s FROM tw JOIN valence USING(lang, word) GROUP BY 1),
 tn AS (SELECT doc.article_id, outlet, coalesce(s,0.0) AS score, CASE WHEN coalesce(s,0)<=-0.5 THEN 'negative' WHEN coalesce(s,0)>=0.5 THEN 'positive' ELSE 'neutral' END AS tone FROM doc LEFT JOIN tv USING(article_id))"""


@query("n5_title_tone", f"WITH {_TONE} SELECT article_id, outlet, score, tone FROM tn", ("doc", "valence"))
def n5(spark, d):
    return lexical.tone(views.doc(spark, d), dims.valence(spark))


@query("b14_outlet_tone", f"WITH {_TONE} SELECT outlet, count(*) FILTER (tone='negative') AS negative, count(*) FILTER (tone='neutral') AS neutral, count(*) FILTER (tone='positive') AS positive FROM tn GROUP BY 1", ("doc", "valence"))
def b14(spark, d):
    return lexical.outlet_tone(lexical.tone(views.doc(spark, d), dims.valence(spark)))


@query("n6_cited_speakers")
def n6(spark, d):
    return lexical.cited_speakers(views.doc(spark, d))


@query("b13_outlet_speakers")
def b13(spark, d):
    return lexical.outlet_speakers(lexical.cited_speakers(views.doc(spark, d)))


@query("n8_story_entities")
def n8(spark, d):
    titles = views.doc(spark, d).select(F.col("outlet").alias("story"), "article_id", "title")
    return lexical.story_entities(titles)


@query("o9_fulltext_backlog", "SELECT article_id FROM doc WHERE length(full_text)<500 AND snippet<>'' ORDER BY article_id DESC LIMIT 50", DOC)
def o9(spark, d):
    return views.doc(spark, d).where("length(full_text) < 500 and snippet <> ''").orderBy(F.desc("article_id")).limit(50).select("article_id")


@query("p23_summary_inputs", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY language, outlet ORDER BY length(full_text)>=1500 DESC, article_id) AS a FROM doc), s AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY length(full_text)>=1500 DESC, article_id) AS b FROM o WHERE a=1)
 SELECT language, article_id, b AS position FROM s WHERE b<=12""", DOC)  # fmt: skip
def p23(spark, d):
    a = views.doc(spark, d).withColumn("long", F.length("full_text") >= 1500)
    one = a.withColumn("rn", F.row_number().over(Window.partitionBy("language", "outlet").orderBy(F.desc("long"), "article_id"))).where("rn = 1")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("long"), "article_id")).cast("long")).where("position <= 12").select("language", "article_id", "position")


@query("p24_prompt_material", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY language, outlet ORDER BY article_id) AS a FROM doc)
 SELECT language, count(*) AS n, md5(string_agg(outlet||chr(10)||title||chr(10)||snippet||chr(10)||substr(full_text,1,1200), chr(10) ORDER BY outlet)) AS prompt FROM o WHERE a=1 GROUP BY 1""", DOC)  # fmt: skip
def p24(spark, d):
    one = views.doc(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("language", "outlet").orderBy("article_id"))).where("rn = 1")
    line = F.concat_ws("\n", "outlet", "title", "snippet", F.substring("full_text", 1, 1200))
    return one.groupBy("language").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("outlet", line.alias("line")))), lambda x: x["line"]), "\n")).alias("prompt"))


@query("p18_display_title", """WITH t AS (SELECT outlet, language, title, row_number() OVER (PARTITION BY outlet, language ORDER BY (snippet='')::INT, article_id) AS rn FROM doc WHERE title<>'')
 SELECT s.outlet, coalesce(md5(t.title), '') AS subtitle FROM (SELECT DISTINCT outlet FROM doc) s LEFT JOIN t ON t.outlet=s.outlet AND t.language='fr' AND rn=1""", DOC)  # fmt: skip
def p18(spark, d):
    a = views.doc(spark, d)
    best = a.where("title <> '' and language = 'fr'").groupBy("outlet").agg(F.min_by("title", F.struct((F.col("snippet") == "").cast("int").alias("bare"), "article_id")).alias("title"))
    return a.select("outlet").distinct().join(best, "outlet", "left").select("outlet", F.coalesce(F.md5("title"), F.lit("")).alias("subtitle"))


@query("p20_translation_gaps", """WITH h AS (SELECT DISTINCT outlet, language FROM doc), t AS (SELECT unnest(['de','en','es','fr','it']) AS target) SELECT outlet, string_agg(target, ',' ORDER BY target) AS missing FROM (SELECT DISTINCT outlet FROM doc) o, t
 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.outlet=o.outlet AND h.language=target) GROUP BY 1""", DOC)  # fmt: skip
def p20(spark, d):
    a = views.doc(spark, d)
    targets = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr", "it")))
    have = a.groupBy("outlet").agg(F.collect_set("language").alias("have"))
    return have.select("outlet", F.array_join(F.array_sort(F.array_except(targets, "have")), ",").alias("missing")).where("missing <> ''")


@query("b21_positioning_regression")
def b21(spark, d):
    """Mean ratings of articles by axis, their embeddings as features; positions of outlets by the axes with 200 examples."""
    rated = views.ann(spark, d).groupBy("article_id", "axis", "outlet").agg(F.avg("value").alias("label"))
    features = views.emb(spark, d).select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("features"))
    examples = rated.join(features, "article_id")
    models = positioning.fit(examples)
    found = positioning.outlet_positions(examples.select("article_id", "outlet", "features").distinct(), models)
    return found.select("outlet", "axis", "articles", F.round("position", 6).alias("position"), F.round("mae", 6).alias("mae"), "examples")


_SIGNALS = f"""{cq._AGENDA}, {cq._SPOTS}, {cq._PAIRS}, {_FRAME}, {_TONE}, {cq._gate_sql(-1.0)}, {cq._LABEL},
 l AS (SELECT outlet_id::VARCHAR AS outlet, 'agenda' AS type, NULL AS axis, topic AS item, deviation AS number FROM a WHERE c>=2
 UNION ALL SELECT outlet_id::VARCHAR, 'blindspot', NULL, 'n', count(*)::DOUBLE FROM sp GROUP BY 1 UNION ALL SELECT outlet_id::VARCHAR, 'blindspot', NULL, 'peers', max(peers)::DOUBLE FROM sp GROUP BY 1
 UNION ALL SELECT outlet, 'framing', NULL, grp||'/'||term, sum(n)::DOUBLE FROM fc WHERE outlet IN (SELECT outlet FROM doc GROUP BY 1 HAVING count(*)>=5) GROUP BY outlet, grp, term
 UNION ALL SELECT outlet, 'tone', NULL, k.tone, count(*) FILTER (tn.tone=k.tone)::DOUBLE FROM tn, (VALUES ('negative'),('neutral'),('positive')) k(tone) GROUP BY outlet, k.tone
 UNION ALL SELECT outlet, 'annotation', axis, 'published', (missing='')::INT::DOUBLE FROM gt UNION ALL SELECT outlet, 'annotation', axis, 'label', label FROM gt JOIN lb USING(outlet, axis) WHERE missing='')"""


def _families(spark, c, a, d):
    """Signals of all families but the map, in long form."""
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    return [
        signals.signal_rows("agenda", signals.agenda(c).groupBy("outlet_id").agg(pairs("topic", "deviation").alias("v")), "outlet_id", F.col("v")),
        signals.signal_rows("blindspot", signals.outlet_blind_spot_summary(c), "outlet_id", F.struct("n", "peers")),
        signals.signal_rows("framing", lexical.outlet_framing(lexical.frame_counts(a, dims.frames(spark)), a).groupBy("outlet").agg(pairs(F.concat_ws("/", "grp", "term").alias("term"), "n").alias("v")), "outlet", F.col("v")),
        signals.signal_rows("actors", lexical.outlet_speakers(lexical.cited_speakers(a)).groupBy("outlet").agg(pairs("speaker", "n").alias("v")), "outlet", F.col("v")),
        signals.signal_rows("tone", lexical.outlet_tone(lexical.tone(a, dims.valence(spark))), "outlet", F.struct("negative", "neutral", "positive")),
        signals.signal_rows("annotation", annotation.signals(views.ann(spark, d), min_alpha=-1.0), "outlet", F.struct("label", "published", "missing"), F.col("axis")),
    ]


def _stored(spark, families, c):
    """What a store holds after a run of these families over the whole fixture."""
    first, last = c.agg(F.min("published_at"), F.max("published_at")).first()
    store = SignalStore(spark, shared_dir(spark, "signals"))
    store.write(signals.signal_run(families, F.lit(first), F.lit(last)), "weekly-run")
    return store.read()


@query("b20_signal_run", f"""WITH {_SIGNALS}, w AS (SELECT min(published_at)::DATE AS period_start, max(published_at)::DATE AS period_end FROM cov)
 SELECT outlet, type, axis, item, round(number,4)+0.0 AS number, period_start::VARCHAR AS period_start, period_end::VARCHAR AS period_end FROM
 (SELECT * FROM l UNION ALL SELECT outlet_id::VARCHAR, 'cocoverage', NULL, unnest(['x','y']), NULL FROM (SELECT DISTINCT outlet_id FROM p)), w""", ("cov", "doc", "ann", "frames", "valence"))  # fmt: skip
def b20(spark, d):
    """All families over the whole fixture, written to a signal store and read back, one row for each number of a signal.

    Coordinates of the map have no SQL form, so their numbers are left out here (tests hold them against numpy); the
    given prose cites nobody, so the family of speakers is empty here and in the SQL.
    """
    c = views.cov(spark, d)
    families = [*_families(spark, c, views.doc(spark, d), d), signals.signal_rows("cocoverage", signals.cocoverage_map(c), "outlet_id", F.struct("x", "y"))]
    stored = _stored(spark, families, c)
    told = stored.select("outlet", "type", "axis", "period_start", "period_end", F.explode(F.from_json("value", "map<string,string>")).alias("item", "text")).where("item <> 'missing'")
    number = F.when(F.col("text") == "true", 1.0).when(F.col("text") == "false", 0.0).when(F.col("type") != "cocoverage", F.round(F.col("text").try_cast("double"), 4) + 0.0)
    return told.select("outlet", "type", "axis", "item", number.alias("number"), F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"))


@query("p17_signal_views", f"""WITH {_SIGNALS}, t AS (SELECT * FROM l WHERE type<>'framing' UNION ALL SELECT outlet, type, axis, split_part(item,'/',1), sum(number) FROM l WHERE type='framing' GROUP BY 1,2,3,4),
 r AS (SELECT *, row_number() OVER (PARTITION BY outlet, type ORDER BY number DESC, item) AS place, row_number() OVER (PARTITION BY outlet, type ORDER BY number, item DESC) AS back, sum(number) OVER (PARTITION BY outlet, type) AS whole FROM t WHERE number IS NOT NULL)
 SELECT outlet, 'agenda over' AS view, axis, place, item, round(number*100,1)+0.0 AS value FROM r WHERE type='agenda' AND place<=3 UNION ALL SELECT outlet, 'agenda under', axis, back, item, round(number*100,1)+0.0 FROM r WHERE type='agenda' AND back<=3
 UNION ALL SELECT outlet, 'tone', axis, place, item, round(number*100/CASE WHEN whole=0 THEN 1 ELSE whole END) FROM r WHERE type='tone' UNION ALL SELECT outlet, 'framing', axis, place, item, number FROM r WHERE type='framing' AND place<=4
 UNION ALL SELECT outlet, type, axis, NULL, item, number FROM r WHERE type IN ('blindspot','annotation')""", ("cov", "doc", "ann", "frames", "valence"))  # fmt: skip
def p17_views(spark, d):
    """What pages show of each outlet's latest stored signals (all families but the map)."""
    c = views.cov(spark, d)
    shown = signals.signal_views(_stored(spark, _families(spark, c, views.doc(spark, d), d), c))
    return shown.withColumn("value", F.col("value") + 0.0)

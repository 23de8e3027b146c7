"""Queries on the coverage, event, rating and account fixtures with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotation, collection, coverage, signals
from . import views
from .views import with_views as w

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query under ``name`` with its oracle over the views it uses."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = w(sql, *uses) if uses else sql
        return f

    return add


def _as_of(df):
    """The fixture's clock: its last event time, one row."""
    return df.agg(F.max("published_at").alias("as_of"))


def _clocked(df):
    return df.crossJoin(F.broadcast(_as_of(df)))  # one row


COV, EVT, ANN = ("cov",), ("evt",), ("ann",)


@query("c7_story_counts", "SELECT story_id, count(*) AS article_count, count(DISTINCT outlet_id) AS source_count FROM cov GROUP BY 1", COV)
def c7(spark, d):
    return coverage.story_counts(views.cov(spark, d))


@query("c8_story_span", "SELECT story_id, epoch_us(min(published_at))//1000000 AS first_seen, epoch_us(max(published_at))//1000000 AS last_seen FROM cov GROUP BY 1", COV)
def c8(spark, d):
    return coverage.story_span(views.cov(spark, d)).select("story_id", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"))


@query("c10_flash_stories", """WITH f AS (SELECT story, outlet_id, min(published_at) AS t FROM evt GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY t, outlet_id) AS rn, min(t) OVER (PARTITION BY story) AS f0 FROM f)
 SELECT story, round((epoch_us(t)-epoch_us(f0))/1e6, 3) AS seconds FROM r WHERE rn=5 AND (epoch_us(t)-epoch_us(f0))/1e6 <= 7200""", EVT)  # fmt: skip
def c10(spark, d):
    return coverage.flash_stories(views.evt(spark, d), "story")


@query("c12_coverage_maps", """SELECT story_id, 'country' AS kind, country::VARCHAR AS name, count(*) AS n FROM cov GROUP BY 1,3
 UNION ALL SELECT story_id, 'language', coalesce(language,'?'), count(*) FROM cov GROUP BY 1,3""", COV)  # fmt: skip
def c12(spark, d):
    return coverage.coverage_long(views.cov(spark, d))


@query("c13_pipeline_lag", "SELECT count(*) AS articles, count(*) FILTER (event_type='error') AS waiting, epoch_us(max(published_at))//1000000 AS newest_article, epoch_us(max(published_at) FILTER (event_type<>'error'))//1000000 AS newest_story FROM evt", EVT)
def c13(spark, d):
    e = views.evt(spark, d)
    at = F.unix_seconds("published_at")
    return e.agg(F.count("*").alias("articles"), F.count_if(F.col("event_type") == "error").alias("waiting"), F.max(at).alias("newest_article"), F.max(F.when(F.col("event_type") != "error", at)).alias("newest_story"))


@query("c5_work_queue", """WITH q AS (SELECT * FROM evt WHERE event_type<>'error' ORDER BY published_at DESC NULLS LAST, article_id DESC LIMIT 500)
 SELECT article_id, outlet_id, row_number() OVER (ORDER BY published_at, article_id) AS position FROM q""", EVT)  # fmt: skip
def c5(spark, d):
    newest = views.evt(spark, d).where("event_type <> 'error'").orderBy(F.desc_nulls_last("published_at"), F.desc("article_id")).limit(500)
    return newest.select("article_id", "outlet_id", F.row_number().over(Window.orderBy("published_at", "article_id")).cast("long").alias("position"))


@query("b1_outlet_topics", "SELECT outlet_id, topic, story_id FROM cov WHERE topic IS NOT NULL", COV)
def b1(spark, d):
    return views.cov(spark, d).where("topic is not null").select("outlet_id", "topic", "story_id")


_SHARES = "s AS (SELECT outlet_id, topic, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY outlet_id) AS share FROM cov WHERE topic IS NOT NULL GROUP BY 1,2)"


@query("b2_topic_shares", f"WITH {_SHARES} SELECT outlet_id, topic, n, round(share::DOUBLE,6) AS share FROM s", COV)
def b2(spark, d):
    return signals.topic_shares(views.cov(spark, d)).select("outlet_id", "topic", "n", F.round("share", 6).alias("share"))


_AGENDA = f"""{_SHARES}, e AS (SELECT outlet_id FROM s GROUP BY 1 HAVING sum(n)>=10),
 g AS (SELECT e.outlet_id, t.topic, coalesce(s.share,0)::DOUBLE AS share FROM e CROSS JOIN (SELECT DISTINCT topic FROM s JOIN e USING(outlet_id)) t LEFT JOIN s ON s.outlet_id=e.outlet_id AND s.topic=t.topic),
 a AS (SELECT outlet_id, topic, share, share-avg(share) OVER (PARTITION BY topic) AS deviation, count(*) OVER (PARTITION BY topic) AS c FROM g)"""


@query("b3_agenda", f"WITH {_AGENDA} SELECT outlet_id, topic, round(share,6) AS share, round(deviation,6) AS deviation FROM a WHERE c>=2", COV)
def b3(spark, d):
    return signals.agenda(views.cov(spark, d)).select("outlet_id", "topic", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"))


@query("b4_agenda_interval")
def b4(spark, d):
    return signals.agenda_interval(views.cov(spark, d))


_PAIRS = """p0 AS (SELECT DISTINCT outlet_id, story_id FROM cov), p1 AS (SELECT * FROM p0 WHERE story_id IN (SELECT story_id FROM p0 GROUP BY 1 HAVING count(*)>=2)),
 p AS (SELECT * FROM p1 WHERE outlet_id IN (SELECT outlet_id FROM p1 GROUP BY 1 HAVING count(*)>=3))"""


@query("b5_cocoverage_pairs", f"WITH {_PAIRS} SELECT outlet_id, story_id FROM p", COV)
def b5(spark, d):
    return signals.cocoverage_pairs(views.cov(spark, d)).select("outlet_id", "story_id")


@query("b6_cocoverage_gram", f"""WITH {_PAIRS}, z AS (SELECT outlet_id, count(*) AS size FROM p GROUP BY 1),
 k0 AS (SELECT a.outlet_id AS i, b.outlet_id AS j, count(*) AS n FROM p a JOIN p b USING(story_id) GROUP BY 1,2),
 k AS (SELECT x.outlet_id AS i, y.outlet_id AS j, coalesce(n,0)/sqrt(x.size*y.size::DOUBLE) AS k FROM z x CROSS JOIN z y LEFT JOIN k0 ON k0.i=x.outlet_id AND k0.j=y.outlet_id)
 SELECT i, j, round(k,6) AS k, round(k-avg(k) OVER (PARTITION BY i)-avg(k) OVER (PARTITION BY j)+avg(k) OVER (),6)+0.0 AS centred FROM k""", COV)  # fmt: skip
def b6(spark, d):
    gram = signals.cocoverage_gram(signals.cocoverage_pairs(views.cov(spark, d)))
    return gram.select("i", "j", F.round("k", 6).alias("k"), (F.round("centred", 6) + 0.0).alias("centred"))


@query("b6_cocoverage_map")
def b6_map(spark, d):
    return signals.cocoverage_map(views.cov(spark, d))


@query("b7_map_loadings")
def b7(spark, d):
    return signals.map_loadings(views.cov(spark, d))


@query("b8_position_signals")
def b8(spark, d):
    c = views.cov(spark, d)
    dated = signals.cocoverage_map(c).crossJoin(F.broadcast(_as_of(c)))  # one row
    return dated.select("outlet_id", F.lit("cocoverage").alias("type"), F.lit(None).cast("string").alias("axis"), F.to_date("as_of").alias("period_end"), F.to_json(F.struct("x", "y")).alias("value"))


_ACTIVE = "pr AS (SELECT DISTINCT outlet_id, country, story_id FROM cov), ac AS (SELECT DISTINCT outlet_id, country FROM pr)"
_SPOTS = f"""{_ACTIVE}, pe AS (SELECT country, count(*) AS active FROM ac GROUP BY 1 HAVING count(*)>=3), co AS (SELECT country, story_id, count(*) AS covering FROM pr GROUP BY 1,2),
 sp AS (SELECT ac.outlet_id, co.story_id, covering, active-1 AS peers FROM co JOIN pe USING(country) JOIN ac USING(country)
 WHERE covering>=greatest(2.0, round_even(0.5*(active-1),0)) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.outlet_id=ac.outlet_id AND pr.story_id=co.story_id))"""


@query("b9_outlet_blind_spots", f"WITH {_SPOTS} SELECT outlet_id, story_id, covering, peers FROM sp", COV)
def b9(spark, d):
    return signals.outlet_blind_spots(views.cov(spark, d))


@query("b9_blind_spot_summary", f"""WITH {_SPOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY story_id DESC) AS rn FROM sp)
 SELECT outlet_id, count(*) AS n, max(peers) AS peers, string_agg(story_id::VARCHAR, ',' ORDER BY story_id) FILTER (rn<=50) AS stories FROM r GROUP BY 1""", COV)  # fmt: skip
def b9_summary(spark, d):
    return signals.outlet_blind_spot_summary(views.cov(spark, d))


_BIG = f"""{_ACTIVE}, bg AS (SELECT story_id, count(*) AS cs, count(DISTINCT country) AS cc FROM pr GROUP BY 1 HAVING count(*)>=5), bp AS (SELECT pr.*, cs, cc FROM pr JOIN bg USING(story_id)),
 tot AS (SELECT count(DISTINCT story_id) AS total FROM bp HAVING count(DISTINCT story_id)>=10),
 pp AS (SELECT ac.outlet_id, ac.country, coalesce(n,0)/total::DOUBLE AS p FROM ac CROSS JOIN tot LEFT JOIN (SELECT outlet_id, count(*) AS n FROM bp GROUP BY 1) h ON h.outlet_id=ac.outlet_id)"""


@query("b10_propensity", f"WITH {_BIG} SELECT outlet_id, country, round(p,8) AS p FROM pp", COV)
def b10(spark, d):
    return signals.propensity(views.cov(spark, d)).select("outlet_id", "country", F.round("p", 8).alias("p"))


_HITS = f"""{_BIG}, ch AS (SELECT country, count(*) AS active, product(1-p) AS p_null FROM pp GROUP BY 1 HAVING count(*)>=3), st AS (SELECT DISTINCT story_id, cs, cc FROM bp WHERE cc>=3),
 ab AS (SELECT story_id, ch.country, p_null, active, cs, cc FROM st CROSS JOIN ch WHERE round(p_null,10)<0.05 AND NOT EXISTS (SELECT 1 FROM bp WHERE bp.story_id=st.story_id AND bp.country=ch.country)),
 hit AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY round(p_null,10), country) AS rk FROM ab)"""


@query("b11_country_blind_spots", f"""WITH {_HITS}, fs AS (SELECT story_id, min(published_at) AS f FROM cov GROUP BY 1)
 SELECT story_id, country, round(p_null,4) AS p_null, active, cs AS covering_sources, cc AS covering_countries FROM hit JOIN fs USING(story_id)
 WHERE rk<=3 AND f <= (SELECT max(published_at) FROM cov) - INTERVAL 6 HOUR""", COV)  # fmt: skip
def b11(spark, d):
    c = views.cov(spark, d)
    as_of = c.agg(F.max("published_at")).first()[0]
    return signals.country_blind_spots(c, F.lit(as_of))


@query("b11_blind_spot_flags", f"""WITH {_HITS} SELECT story_id, coalesce(n,0) AS n, coalesce(countries,'') AS countries FROM (SELECT DISTINCT story_id FROM cov)
 LEFT JOIN (SELECT story_id, count(*) AS n, string_agg(country::VARCHAR, ',' ORDER BY country) AS countries FROM hit WHERE rk<=3 GROUP BY 1) USING(story_id)""", COV)  # fmt: skip
def b11_flags(spark, d):
    return signals.blind_spot_flags(views.cov(spark, d))


_BRACKET = "CASE WHEN self_axis < -0.5 THEN 'low' WHEN self_axis > 0.5 THEN 'high' ELSE 'middle' END"
_ALPHA = """ct AS (SELECT outlet, axis, article_id, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY outlet, axis, article_id) AS m FROM ann GROUP BY 1,2,3,4),
 ci AS (SELECT a.outlet, a.axis, a.value AS c, b.value AS k, sum(a.n*(b.n-(a.value=b.value)::INT)/(a.m-1)::DOUBLE) AS o FROM ct a JOIN ct b USING(outlet,axis,article_id) WHERE a.m>=2 GROUP BY 1,2,3,4),
 mg AS (SELECT outlet, axis, c, sum(o) AS nc, sum(sum(o)) OVER (PARTITION BY outlet, axis ORDER BY c) AS up, sum(sum(o)) OVER (PARTITION BY outlet, axis) AS n FROM ci GROUP BY 1,2,3),
 gr AS (SELECT x.outlet, x.axis, x.c, y.c AS k, x.nc AS na, y.nc AS nb, power(CASE WHEN x.c<=y.c THEN y.up-x.up+x.nc ELSE x.up-y.up+y.nc END-(x.nc+y.nc)/2,2) AS dl FROM mg x JOIN mg y USING(outlet,axis) WHERE x.c<>y.c),
 sm AS (SELECT gr.outlet, gr.axis, sum(coalesce(o,0)*dl) AS ob, sum(na*nb*dl) AS ex FROM gr LEFT JOIN ci ON ci.outlet=gr.outlet AND ci.axis=gr.axis AND ci.c=gr.c AND ci.k=gr.k GROUP BY 1,2),
 al AS (SELECT DISTINCT t.outlet, t.axis, round(CASE WHEN n<=1 THEN NULL WHEN coalesce(ex,0)=0 THEN 1.0 ELSE 1-(n-1)*ob/ex END,6) AS alpha FROM (SELECT DISTINCT outlet, axis FROM ann) t
  LEFT JOIN (SELECT outlet, axis, max(n) AS n FROM mg GROUP BY 1,2) q ON q.outlet=t.outlet AND q.axis=t.axis LEFT JOIN sm ON sm.outlet=t.outlet AND sm.axis=t.axis)"""


@query("b15_agreement", f"WITH {_ALPHA} SELECT outlet, axis, round(alpha,4) AS alpha FROM al", ANN)
def b15(spark, d):
    return annotation.agreement(views.ann(spark, d)).select("outlet", "axis", F.round("alpha", 4).alias("alpha"))


@query("b16_brackets", f"SELECT {_BRACKET} AS bracket, count(*) AS n, count(DISTINCT annotator_id) AS annotators FROM ann GROUP BY 1", ANN)
def b16(spark, d):
    return views.ann(spark, d).groupBy(annotation.bracket("self_axis").alias("bracket")).agg(F.count("*").alias("n"), F.countDistinct("annotator_id").alias("annotators"))


_LABEL = f"lb AS (SELECT outlet, axis, round(avg(m),2) AS label FROM (SELECT outlet, axis, {_BRACKET} AS b, avg(value) AS m FROM ann GROUP BY 1,2,3) GROUP BY 1,2)"


@query("b17_outlet_labels", f"WITH {_LABEL} SELECT outlet, axis, label FROM lb", ANN)
def b17(spark, d):
    return annotation.label(views.ann(spark, d))


def _gate_sql(alpha: float) -> str:
    return f"""{_ALPHA}, ft AS (SELECT outlet, axis, count(DISTINCT article_id) AS articles, count(DISTINCT annotator_id) AS annotators, count(DISTINCT {_BRACKET}) AS brackets FROM ann GROUP BY 1,2),
 gt AS (SELECT ft.*, array_to_string(list_filter([CASE WHEN articles<50 THEN 'articles' END, CASE WHEN annotators<3 THEN 'annotators' END, CASE WHEN brackets<2 THEN 'brackets' END,
  CASE WHEN alpha IS NULL OR alpha<{alpha} THEN 'agreement' END], lambda x: x IS NOT NULL), ',') AS missing FROM ft JOIN al USING(outlet, axis))"""


@query("b18_publication_gate", f"WITH {_gate_sql(0.6)} SELECT outlet, axis, articles, annotators, brackets, missing, missing='' AS published FROM gt", ANN)
def b18(spark, d):
    return annotation.gate(views.ann(spark, d)).select("outlet", "axis", "articles", "annotators", "brackets", "missing", "published")


@query("b19_annotation_signals", f"WITH {_gate_sql(-1.0)}, {_LABEL} SELECT outlet, axis, CASE WHEN missing='' THEN label END AS label, missing='' AS published, missing FROM gt LEFT JOIN lb USING(outlet, axis)", ANN)
def b19(spark, d):
    return annotation.signals(views.ann(spark, d), min_alpha=-1.0)


@query("s16_training_rows", "SELECT article_id, round(avg(value) FILTER (axis='F'),6) AS axis_f, round(avg(value) FILTER (axis='O'),6) AS axis_o FROM ann GROUP BY 1", ANN)
def s16(spark, d):
    return annotation.training_rows(views.ann(spark, d))


@query("s12_annotations_csv", "SELECT article_id, 'a'||annotator_id AS annotator, axis, value FROM ann", ANN)
def s12(spark, d):
    return views.ann(spark, d).select("article_id", F.concat(F.lit("a"), F.col("annotator_id").cast("string")).alias("annotator"), "axis", "value")


@query("p27_assignment", """WITH rt AS (SELECT DISTINCT article_id, outlet FROM ann WHERE annotator_id=3), dn AS (SELECT o.outlet, count(rt.article_id) AS done FROM (SELECT DISTINCT outlet FROM ann) o LEFT JOIN rt USING(outlet) GROUP BY 1),
 nw AS (SELECT outlet, article_id, row_number() OVER (PARTITION BY outlet ORDER BY article_id DESC) AS rn FROM (SELECT DISTINCT outlet, article_id FROM ann))
 SELECT outlet, article_id, done FROM nw JOIN dn USING(outlet) WHERE rn<=200 AND article_id NOT IN (SELECT article_id FROM rt) ORDER BY done, outlet, md5('3/'||article_id) LIMIT 1""", ANN)  # fmt: skip
def p27(spark, d):
    return annotation.assignment(views.ann(spark, d), 3)


@query("p28_annotation_upsert", """SELECT article_id, annotator_id, axis, CASE WHEN annotator_id%2=0 AND axis='F' THEN NULL ELSE value END AS value FROM ann""", ANN)
def p28(spark, d):
    old = views.ann(spark, d).select("article_id", "annotator_id", "axis", "value")
    new = old.where("annotator_id % 2 = 0 and axis = 'F'").withColumn("value", F.lit(None).cast("int"))
    return annotation.upsert(old, new)


@query("p28_annotator_progress", "SELECT annotator_id, count(DISTINCT article_id) AS articles FROM ann GROUP BY 1", ANN)
def p28_progress(spark, d):
    return views.ann(spark, d).groupBy("annotator_id").agg(F.countDistinct("article_id").alias("articles"))


@query("o1_shared_accounts", """SELECT exchange, publisher_id, count(*) AS outlets, string_agg(outlet_id::VARCHAR, ',' ORDER BY outlet_id) AS members FROM (SELECT DISTINCT * FROM acct) GROUP BY 1,2 HAVING count(*)>1""", ("acct",))
def o1(spark, d):
    return collection.shared_accounts(views.acct(spark, d))


@query("o4_failure_streaks", """WITH i AS (SELECT *, sum(CASE WHEN event_type='error' THEN 0 ELSE 1 END) OVER (PARTITION BY outlet_id ORDER BY published_at, article_id ROWS UNBOUNDED PRECEDING) AS isl FROM evt),
 b AS (SELECT outlet_id, isl, count(*) FILTER (event_type='error') AS f, max(published_at) AS l FROM i GROUP BY 1,2),
 s AS (SELECT outlet_id, arg_max(f, isl) AS streak, max(f) AS longest, max(l) AS last FROM b GROUP BY 1)
 SELECT outlet_id, streak, longest, streak>=3 AND (epoch_us((SELECT max(published_at) FROM evt))-epoch_us(last))/3.6e9 < 6 AS in_backoff FROM s""", EVT)  # fmt: skip
def o4(spark, d):
    e = views.evt(spark, d)
    return collection.failure_streaks(e, F.lit(e.agg(F.max("published_at")).first()[0]))


@query("o5_feed_verdicts", """WITH f AS (SELECT outlet_id, event_type, arg_max(value>=10, (published_at, article_id)) AS ok FROM evt GROUP BY 1,2)
 SELECT outlet_id, bool_or(ok) AS enabled, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT ok), '') AS failing FROM f GROUP BY 1""", EVT)  # fmt: skip
def o5(spark, d):
    return collection.feed_verdicts(views.evt(spark, d))


@query("o6_courtesy_audit", """WITH g AS (SELECT outlet_id, article_id, (epoch_us(published_at)-lag(epoch_us(published_at)) OVER (PARTITION BY outlet_id ORDER BY published_at, article_id))/1e6 AS gap FROM evt)
 SELECT outlet_id, article_id, round(gap,3) AS gap FROM g WHERE gap < CASE WHEN outlet_id%5=0 THEN 500.0 ELSE 200.0 END""", EVT)  # fmt: skip
def o6(spark, d):
    return collection.courtesy_audit(views.evt(spark, d), 200.0, 500.0)


@query("o7_query_batches", """WITH o AS (SELECT DISTINCT outlet_id, outlet_id%4<>0 AS f FROM cov), b AS (SELECT *, CASE WHEN f THEN (row_number() OVER (PARTITION BY f ORDER BY outlet_id)-1)//6 ELSE outlet_id END AS batch FROM o)
 SELECT f AS has_feed, batch::BIGINT AS batch, string_agg('domain:'||outlet_id, ' OR ' ORDER BY outlet_id) AS query, count(*) AS n FROM b GROUP BY 1,2""", COV)  # fmt: skip
def o7(spark, d):
    outlets = views.cov(spark, d).select("outlet_id").distinct().withColumn("has_feed", F.col("outlet_id") % 4 != 0)
    return collection.query_batches(outlets)


@query("o8_new_articles", "SELECT strftime(published_at,'%Y-%m-%d') AS run, outlet_id, count(*) AS n FROM evt GROUP BY 1,2", EVT)
def o8(spark, d):
    return views.evt(spark, d).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("run"), "outlet_id").agg(F.count("*").alias("n"))


@query("o2_refresh_due", """WITH p AS (SELECT outlet_id, max(published_at) FILTER (event_type='click') AS t, count(*)%3=0 AS e FROM evt GROUP BY 1), a AS (SELECT max(published_at) AS n FROM evt)
 SELECT outlet_id, e AS empty FROM p, a WHERE t IS NULL OR (e AND (epoch_us(n)-epoch_us(t))/3.6e9>=6) OR (epoch_us(n)-epoch_us(t))/3.6e9>=336 ORDER BY t NULLS FIRST, outlet_id LIMIT 20""", EVT)  # fmt: skip
def o2(spark, d):
    e = views.evt(spark, d)
    profiles = e.groupBy("outlet_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("published_at"))).alias("profiled_at"), (F.count("*") % 3 == 0).alias("empty"))
    return collection.refresh_due(profiles, F.lit(e.agg(F.max("published_at")).first()[0]), 20)


@query("o3_profiled_outlets", "SELECT count(*) AS outlets, count(*) FILTER (n>=1000) AS profiled FROM (SELECT outlet_id, count(*) AS n FROM cov GROUP BY 1)", COV)
def o3(spark, d):
    return views.cov(spark, d).groupBy("outlet_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("outlets"), F.count_if(F.col("n") >= 1000).alias("profiled"))


@query("o10_reader_languages", """WITH u AS (SELECT event_type AS language, max(published_at) AS last FROM evt WHERE published_at >= (SELECT max(published_at) FROM evt) - INTERVAL 7 DAY GROUP BY 1),
 dm AS (SELECT unnest(['signup','purchase','view','click','error','other']) AS language, unnest([0,1,2,3,4,5]) AS o)
 SELECT language, row_number() OVER (ORDER BY last DESC NULLS LAST, o) AS priority FROM dm LEFT JOIN u USING(language)""", EVT)  # fmt: skip
def o10(spark, d):
    e = views.evt(spark, d).withColumnRenamed("event_type", "language")
    return collection.reader_languages(e, F.lit(e.agg(F.max("published_at")).first()[0]), ["signup", "purchase", "view", "click", "error", "other"])


@query("g1_latest_provenance", "SELECT outlet_id, event_type, article_id FROM (SELECT *, row_number() OVER (PARTITION BY outlet_id, event_type ORDER BY published_at DESC, article_id DESC) AS rn FROM evt) WHERE rn=1", EVT)
def g1(spark, d):
    return collection.latest_record(views.evt(spark, d), ["outlet_id", "event_type"], [F.desc("published_at"), F.desc("article_id")]).select("outlet_id", "event_type", "article_id")


@query("e16_first_capture", "SELECT outlet_id, strftime(min(published_at),'%Y-%m-%d') AS first_copy FROM evt GROUP BY 1", EVT)
def e16(spark, d):
    return views.evt(spark, d).groupBy("outlet_id").agg(F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("first_copy"))


@query("s2_catalogue_upsert", """WITH o AS (SELECT outlet_id AS slug, min(topic) AS name FROM cov WHERE outlet_id<40 GROUP BY 1), n AS (SELECT outlet_id AS slug, max(topic) AS name FROM cov WHERE outlet_id>=20 AND language='A' GROUP BY 1)
 SELECT slug, coalesce(n.name,o.name) AS name, CASE WHEN o.slug IS NULL THEN 'created' WHEN n.slug IS NOT NULL AND o.name IS DISTINCT FROM n.name THEN 'updated' ELSE 'kept' END AS status FROM o FULL JOIN n USING(slug)""", COV)  # fmt: skip
def s2(spark, d):
    c = views.cov(spark, d)
    old = c.where("outlet_id < 40").groupBy(F.col("outlet_id").alias("slug")).agg(F.min("topic").alias("name"))
    new = c.where("outlet_id >= 20 and language = 'A'").groupBy(F.col("outlet_id").alias("slug")).agg(F.max("topic").alias("name"))
    return collection.catalogue_upsert(old, new)


@query("s8_ownership_load", "SELECT owner, count(*) FILTER (outlet_id<30) AS edges, count(*) FILTER (outlet_id>=30) AS skipped FROM own GROUP BY 1", ("own",))
def s8(spark, d):
    return collection.ownership_load(views.own(spark, d), views.cov(spark, d).where("outlet_id < 30"))


@query("p12_first_owner", "SELECT outlet_id, min(owner) AS owner, count(*) AS owners FROM own GROUP BY 1", ("own",))
def p12(spark, d):
    return collection.first_owner(views.own(spark, d))


@query("p16_outlet_record", """SELECT c.outlet_id, articles, owners, years, fund AS funding FROM (SELECT outlet_id, count(*) AS articles FROM cov GROUP BY 1) c
 LEFT JOIN (SELECT outlet_id, string_agg(DISTINCT owner, ';' ORDER BY owner) AS owners FROM own GROUP BY 1) o ON o.outlet_id=c.outlet_id
 LEFT JOIN (SELECT outlet_id, string_agg(year::VARCHAR, ',' ORDER BY year DESC) AS years, round(sum(a)/1000,1) AS fund FROM (SELECT outlet_id, year, round(sum(amount),2) AS a FROM funding GROUP BY 1,2) GROUP BY 1) f ON f.outlet_id=c.outlet_id""", ("cov", "own", "funding"))  # fmt: skip
def p16(spark, d):
    return collection.outlet_record(views.cov(spark, d), views.own(spark, d), views.funding(spark, d))


_W = "greatest(x,1)*power(0.5,h/12)+6*power(0.5,h/2)"
_TOP = """cl AS (SELECT max(published_at) AS n FROM evt), sp AS (SELECT story, max(published_at) AS ls FROM evt GROUP BY 1),
 fr AS (SELECT story, ls FROM sp, cl WHERE ls >= n - INTERVAL 48 HOUR ORDER BY ls DESC, story LIMIT 200),
 rc AS (SELECT story, count(DISTINCT outlet_id) AS r FROM evt, cl WHERE published_at >= n - INTERVAL 24 HOUR GROUP BY 1),
 tp AS (SELECT story, coalesce(r,1) AS recent_outlets, round(greatest(coalesce(r,1),1)*power(0.5,greatest((epoch_us(n)-epoch_us(ls))/3.6e9,0)/12)+6*power(0.5,greatest((epoch_us(n)-epoch_us(ls))/3.6e9,0)/2),4) AS weight FROM fr CROSS JOIN cl LEFT JOIN rc USING(story))"""


def _clock(df):
    return F.lit(df.agg(F.max("published_at")).first()[0])


@query("p1_story_weights", """SELECT story, round(greatest(x,1)*power(0.5,h/12)+6*power(0.5,h/2),5) AS weight FROM (SELECT story, count(DISTINCT outlet_id) AS x,
 (epoch_us((SELECT max(published_at) FROM evt))-epoch_us(max(published_at)))/3.6e9 AS h FROM evt GROUP BY 1)""", EVT)  # fmt: skip
def p1(spark, d):
    e = views.evt(spark, d)
    stories = e.groupBy("story").agg(F.countDistinct("outlet_id").alias("outlets"), F.max("published_at").alias("last_seen"))
    return stories.select("story", F.round(coverage.weight("outlets", "last_seen", _clock(e)), 5).alias("weight"))


@query("p2_recent_coverage", "SELECT story, count(DISTINCT outlet_id) AS recent_outlets FROM evt WHERE published_at >= (SELECT max(published_at) FROM evt) - INTERVAL 24 HOUR GROUP BY 1", EVT)
def p2(spark, d):
    e = views.evt(spark, d)
    return coverage.recent_coverage(e, _clock(e), "story")


@query("p3_front_page", f"WITH {_TOP} SELECT story, recent_outlets, weight FROM tp ORDER BY weight DESC, story LIMIT 8", EVT)
def p3(spark, d):
    e = views.evt(spark, d)
    return coverage.top_stories(e, _clock(e), "story", 8)


@query("p4_country_edition", """WITH s AS (SELECT story_id, count(*) FILTER (country=3) AS n, (epoch_us((SELECT max(published_at) FROM cov))-epoch_us(max(published_at)))/3.6e9 AS h FROM cov GROUP BY 1)
 SELECT story_id, n, round(greatest(n,1)*power(0.5,h/8760)+6*power(0.5,h/2),6) AS weight FROM s WHERE n>0""", COV)  # fmt: skip
def p4(spark, d):
    c = views.cov(spark, d)
    s = c.groupBy("story_id").agg(F.count_if(F.col("country") == 3).alias("n"), F.max("published_at").alias("last_seen")).where("n > 0")
    return s.select("story_id", "n", F.round(coverage.weight("n", "last_seen", _clock(c), half_life=8760), 6).alias("weight"))


@query("p5_stories_per_country", "SELECT country, count(DISTINCT story_id) AS stories FROM cov WHERE published_at >= TIMESTAMP '1995-01-01' GROUP BY 1", COV)
def p5(spark, d):
    return views.cov(spark, d).where("published_at >= timestamp '1995-01-01'").groupBy("country").agg(F.countDistinct("story_id").alias("stories"))


@query("p6_breaking", "SELECT story, epoch_us(min(published_at))//1000000 AS first_seen FROM evt GROUP BY 1 HAVING min(published_at) >= (SELECT max(published_at) FROM evt) - INTERVAL 24 HOUR ORDER BY min(published_at) DESC, story LIMIT 6", EVT)
def p6(spark, d):
    e = views.evt(spark, d)
    recent = coverage.story_span(e, "story").where(F.col("first_seen") >= _clock(e) - F.expr("interval 24 hours"))
    return recent.orderBy(F.desc("first_seen"), "story").limit(6).select("story", F.unix_seconds("first_seen").alias("first_seen"))


@query("p7_guaranteed_slots", f"""WITH {_TOP}, t AS (SELECT story, weight FROM tp ORDER BY weight DESC, story LIMIT 4),
 bk AS (SELECT story, count(DISTINCT outlet_id)::DOUBLE AS weight FROM evt GROUP BY 1 HAVING count(DISTINCT outlet_id)>=3 AND min(published_at) >= (SELECT max(published_at) FROM evt) - INTERVAL 24 HOUR),
 mg AS (SELECT story, weight, 1 AS f FROM t UNION ALL SELECT story, weight, 0 FROM bk WHERE story NOT IN (SELECT story FROM t)), k AS (SELECT * FROM mg ORDER BY f, weight DESC, story LIMIT 4)
 SELECT story, weight, row_number() OVER (ORDER BY weight DESC, story) AS place FROM k""", EVT)  # fmt: skip
def p7(spark, d):
    e = views.evt(spark, d)
    top = coverage.top_stories(e, _clock(e), "story", 4).select("story", "weight")
    per = e.groupBy("story").agg(F.countDistinct("outlet_id").cast("double").alias("weight"), F.min("published_at").alias("first_seen"))
    breaking = per.where((F.col("weight") >= 3) & (F.col("first_seen") >= _clock(e) - F.expr("interval 24 hours"))).select("story", "weight")
    return coverage.guaranteed_slots(top, breaking, "story", 4)


@query("p8_version_order", "SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY (country<>3)::INT, (language<>'R')::INT, published_at, article_id) AS position FROM cov", COV)
def p8(spark, d):
    return coverage.version_order(views.cov(spark, d), 3, "R")


@query("p9_flash_edition", """WITH f AS (SELECT story, outlet_id, min(published_at) AS t FROM evt GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY t, outlet_id) AS rn, min(t) OVER (PARTITION BY story) AS f0 FROM f),
 fl AS (SELECT story FROM r WHERE rn=5 AND (epoch_us(t)-epoch_us(f0))/1e6<=7200), s AS (SELECT story, max(published_at) AS ls, count(DISTINCT outlet_id%8) AS countries FROM evt GROUP BY 1)
 SELECT story, countries FROM s WHERE story IN (SELECT story FROM fl) AND ls >= (SELECT max(published_at) FROM evt) - INTERVAL 12 HOUR ORDER BY ls DESC, story LIMIT 20""", EVT)  # fmt: skip
def p9(spark, d):
    e = views.evt(spark, d)
    s = e.groupBy("story").agg(F.max("published_at").alias("last_seen"), F.countDistinct(F.col("outlet_id") % 8).alias("countries"))
    live = s.join(coverage.flash_stories(e, "story"), "story", "left_semi").where(F.col("last_seen") >= _clock(e) - F.expr("interval 12 hours"))
    return live.orderBy(F.desc("last_seen"), "story").limit(20).select("story", "countries")


@query("p10_diverse_versions", """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id, outlet_id ORDER BY published_at, article_id) AS q FROM cov) WHERE q=1),
 a AS (SELECT story_id, article_id AS a, country AS ac, language AS al FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at, article_id) AS q2 FROM o) WHERE q2=1),
 b AS (SELECT story_id, article_id AS b, country AS bc, language AS bl FROM (SELECT o.*, row_number() OVER (PARTITION BY o.story_id ORDER BY (country<>ac)::INT+0.5*(language<>al)::INT DESC, published_at, article_id) AS q2 FROM o JOIN a USING(story_id) WHERE article_id<>a.a) WHERE q2=1),
 c AS (SELECT story_id, article_id AS c FROM (SELECT o.*, row_number() OVER (PARTITION BY o.story_id ORDER BY least((country<>ac)::INT+0.5*(language<>al)::INT, (country<>bc)::INT+0.5*(language<>bl)::INT) DESC, published_at, article_id) AS q2
   FROM o JOIN a USING(story_id) JOIN b USING(story_id) WHERE article_id<>a.a AND article_id<>b.b) WHERE q2=1)
 SELECT a.story_id, a.a AS first, b.b AS second, c.c AS third FROM a LEFT JOIN b USING(story_id) LEFT JOIN c USING(story_id)""", COV)  # fmt: skip
def p10(spark, d):
    return coverage.diverse_versions(views.cov(spark, d))


@query("p11_latest_position", "SELECT outlet_id, topic, round(n::DOUBLE,2) AS value FROM (SELECT outlet_id, topic, year(published_at) AS y, count(*) AS n, row_number() OVER (PARTITION BY outlet_id, topic ORDER BY year(published_at) DESC) AS rn FROM cov GROUP BY 1,2,3) WHERE rn=1", COV)
def p11(spark, d):
    yearly = views.cov(spark, d).groupBy("outlet_id", "topic", F.year("published_at").alias("period_end")).agg(F.count("*").cast("double").alias("n"))
    return yearly.groupBy("outlet_id", "topic").agg(F.max_by("n", "period_end").alias("value"))


@query("p13_timeline", """SELECT story_id, article_id, outlet_id, row_number() OVER w AS position, (epoch_us(published_at)-first(epoch_us(published_at)) OVER w)//1000000 AS after_first,
 (epoch_us(published_at)-lag(epoch_us(published_at)) OVER w)//1000000 AS after_previous FROM cov WINDOW w AS (PARTITION BY story_id ORDER BY published_at, article_id)""", COV)  # fmt: skip
def p13(spark, d):
    return coverage.timeline(views.cov(spark, d))


@query("p14_masthead", "SELECT count(DISTINCT outlet_id) AS outlets, count(DISTINCT story_id) AS stories, epoch_us(max(published_at))//1000000 AS last_fetch, count(*) AS articles FROM cov", COV)
def p14(spark, d):
    return views.cov(spark, d).agg(F.countDistinct("outlet_id").alias("outlets"), F.countDistinct("story_id").alias("stories"), F.unix_seconds(F.max("published_at")).alias("last_fetch"), F.count("*").alias("articles"))


@query("p15_outlets_by_region", "SELECT country, string_agg(outlet_id::VARCHAR, ',' ORDER BY outlet_id) AS outlets, count(*) AS n FROM (SELECT DISTINCT country, outlet_id FROM cov) GROUP BY 1", COV)
def p15(spark, d):
    outlets = views.cov(spark, d).select("country", "outlet_id").distinct()
    return outlets.groupBy("country").agg(F.array_join(F.array_sort(F.collect_list("outlet_id")), ",").alias("outlets"), F.count("*").alias("n"))


@query("p17_agenda_view", f"""WITH {_AGENDA}, r AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY round(deviation,9) DESC, topic) AS u, row_number() OVER (PARTITION BY outlet_id ORDER BY round(deviation,9), topic) AS v FROM a WHERE c>=2)
 SELECT outlet_id, topic, CASE WHEN u<=3 THEN 'over' ELSE 'under' END AS side, round(deviation,6) AS deviation FROM r WHERE u<=3 OR v<=3""", COV)  # fmt: skip
def p17(spark, d):
    a = signals.agenda(views.cov(spark, d))
    up, down = (Window.partitionBy("outlet_id").orderBy(o, "topic") for o in (F.desc(F.round("deviation", 9)), F.round("deviation", 9)))
    ranked = a.withColumns({"u": F.row_number().over(up), "v": F.row_number().over(down)}).where("u <= 3 or v <= 3")
    return ranked.select("outlet_id", "topic", F.when(F.col("u") <= 3, "over").otherwise("under").alias("side"), F.round("deviation", 6).alias("deviation"))


@query("p21_translation_queue", f"WITH {_TOP} SELECT story, weight FROM tp WHERE story NOT LIKE 'view/%' ORDER BY weight DESC, story LIMIT 5", EVT)
def p21(spark, d):
    e = views.evt(spark, d)
    ranked = coverage.top_stories(e, _clock(e), "story", 200).where(~F.col("story").startswith("view/"))
    return ranked.orderBy(F.desc("weight"), "story").limit(5).select("story", "weight")


@query("p22_summary_queue", """SELECT story, count(DISTINCT outlet_id) AS outlets FROM evt GROUP BY 1 HAVING count(DISTINCT outlet_id)>=2 AND max(published_at) >= (SELECT max(published_at) FROM evt) - INTERVAL 48 HOUR AND story NOT LIKE 'error/%' ORDER BY 2 DESC, 1 LIMIT 5""", EVT)
def p22(spark, d):
    e = views.evt(spark, d)
    s = e.groupBy("story").agg(F.countDistinct("outlet_id").alias("outlets"), F.max("published_at").alias("last_seen"))
    open_ = s.where((F.col("outlets") >= 2) & (F.col("last_seen") >= _clock(e) - F.expr("interval 48 hours")) & ~F.col("story").startswith("error/"))
    return open_.orderBy(F.desc("outlets"), "story").limit(5).select("story", "outlets")


@query("p26_coverage_bars", "SELECT story_id, country, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY story_id),6) AS share FROM cov GROUP BY 1,2", COV)
def p26(spark, d):
    n = views.cov(spark, d).groupBy("story_id", "country").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("story_id")), 6))


@query("p29_map_canvas")
def p29(spark, d):
    m = signals.cocoverage_map(views.cov(spark, d))
    ends = m.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("least", F.min), ("most", F.max))))  # one row
    scaled = lambda c: (F.col(c) - F.col(f"least_{c}")) / F.when(F.col(f"most_{c}") == F.col(f"least_{c}"), 1.0).otherwise(F.col(f"most_{c}") - F.col(f"least_{c}"))
    return m.crossJoin(F.broadcast(ends)).select("outlet_id", scaled("x").alias("px"), scaled("y").alias("py"))


@query("p19_story_language", "SELECT story_id, language FROM (SELECT story_id, language, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, language) AS rn FROM cov GROUP BY 1,2) WHERE rn=1", COV)
def p19(spark, d):
    n = views.cov(spark, d).groupBy("story_id", "language").agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("n"), "language"))).where("rn = 1").select("story_id", "language")


@query("s13_stories_csv", "SELECT story_id, strftime(min(published_at),'%Y-%m-%d') AS first_seen, strftime(max(published_at),'%Y-%m-%d') AS last_seen, min(topic) AS topic, count(*) AS articles, count(DISTINCT outlet_id) AS outlets FROM cov GROUP BY 1", COV)
def s13(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return views.cov(spark, d).groupBy("story_id").agg(day(F.min("published_at")).alias("first_seen"), day(F.max("published_at")).alias("last_seen"), F.min("topic").alias("topic"), F.count("*").alias("articles"), F.countDistinct("outlet_id").alias("outlets"))


@query("s14_coverage_csv", """SELECT story_id, '{'||string_agg('"'||country||'":'||n, ',' ORDER BY country::VARCHAR)||'}' AS by_country FROM (SELECT story_id, country, count(*) AS n FROM cov GROUP BY 1,2) GROUP BY 1""", COV)
def s14(spark, d):
    return coverage.coverage_maps(views.cov(spark, d)).select("story_id", F.to_json("by_country").alias("by_country"))


@query("s15_signals_csv", f"""WITH {_SHARES} SELECT 'o'||outlet_id AS slug, 'agenda' AS type, '{{"'||string_agg(topic||'":'||n, ',"' ORDER BY topic)||'}}' AS value FROM s GROUP BY outlet_id""", COV)
def s15(spark, d):
    shares = signals.topic_shares(views.cov(spark, d)).groupBy("outlet_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "n")))).alias("value"))
    return shares.select(F.concat(F.lit("o"), F.col("outlet_id").cast("string")).alias("slug"), F.lit("agenda").alias("type"), F.to_json("value").alias("value"))

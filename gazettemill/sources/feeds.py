"""Readers of landed feed, search and social files, knowledge-base claims, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens
from ..session import shared_dir

_MEDIA = "array<struct<_url:string,_medium:string,_type:string,_VALUE:string>>"
_PERSON = "array<struct<name:string,_VALUE:string>>"
_FEED = f"""title string, link array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>, description string, summary string, pubDate string, published string, updated string,
    author {_PERSON}, `dc:creator` array<string>, `media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}, thumbnail {_MEDIA}, enclosure {_MEDIA}, `media:group` struct<`media:content`:{_MEDIA},`media:thumbnail`:{_MEDIA}>"""


_CATALOGUE = ["slug", "name", "domain", "country", "language", "region", "enabled", "feed_urls"]


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Outlet catalogue from JSON lines: defaults for region and enabled, unknown keys kept in ``extra``."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", "map<string,string>").alias("m"))
    key = lambda k: F.try_element_at("m", F.lit(k))
    return raw.where(key("slug").isNotNull()).select(
        *(key(k).alias(k) for k in _CATALOGUE[:5]), F.coalesce(key("region"), F.lit("world")).alias("region"), F.coalesce(key("enabled").cast("boolean"), F.lit(True)).alias("enabled"),
        F.coalesce(F.from_json(key("feed_urls"), "array<string>"), F.array().cast("array<string>")).alias("feed_urls"), F.map_filter("m", lambda k, v: ~k.isin(_CATALOGUE)).alias("extra"),
    )


def rss_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS items, or Atom entries (``tag`` entry), with a link and a title; published, else updated date.

    RSS writes the link as text, Atom as the address of a link without a relation or of an alternate.
    """
    raw = spark.read.format("xml").option("rowTag", tag).schema(_FEED).load(path)
    title = F.trim(F.regexp_replace(tokens.unescape(F.col("title")), r"\s+", " "))
    stated = F.transform("link", lambda x: F.when(F.coalesce(x["_rel"], F.lit("alternate")) == "alternate", F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), F.trim(x["_href"]))))
    address = lambda media: F.get(F.filter(F.transform(media, lambda m: F.coalesce(F.nullif(F.trim(m["_url"]), F.lit("")), F.trim(m["_VALUE"]))), lambda u: u != ""), 0)
    pictures = F.filter("enclosure", lambda e: F.coalesce(e["_type"].startswith("image/"), F.lit(False)))
    linked = F.get(F.transform(F.filter("link", lambda x: (x["_rel"] == "enclosure") & F.coalesce(x["_type"].startswith("image/"), F.lit(False))), lambda x: x["_href"]), 0)
    media = F.coalesce(address(F.col("`media:content`")), address(F.col("`media:group`.`media:content`")))
    thumbnail = F.coalesce(address(F.col("`media:thumbnail`")), address(F.col("`media:group`.`media:thumbnail`")), address(F.col("thumbnail")))
    people = F.concat(F.coalesce(F.transform("author", lambda a: F.coalesce(a["name"], a["_VALUE"])), F.array().cast("array<string>")), F.coalesce("`dc:creator`", F.array().cast("array<string>")))
    return raw.select(
        F.get(F.filter(stated, lambda u: u != ""), 0).alias("url"), title.alias("title"), tokens.snippet(F.coalesce("description", "summary", F.lit(""))).alias("snippet"),
        F.coalesce("pubDate", "published", "updated").alias("published"), first_image(media, thumbnail, F.coalesce(address(pictures), linked)).alias("image"),
        authors(people, F.lit(None).cast("string")).alias("authors"),
    ).where("url <> '' and title <> ''")


def search_articles(spark: SparkSession, path: str) -> DataFrame:
    """News-search results with url and title; languages as codes, compact times as timestamps."""
    item = "struct<url:string,title:string,seendate:string,socialimage:string,domain:string,language:string,sourcecountry:string>"
    raw = spark.read.option("multiLine", True).schema(f"articles array<{item}>").json(path).select(F.explode("articles").alias("a"))
    return raw.select(
        "a.url", tokens.tidy_title(F.col("a.title")).alias("title"), compact_time(F.col("a.seendate")).alias("seen"),
        F.nullif(F.col("a.socialimage"), F.lit("")).alias("image"), "a.domain", language_code(F.col("a.language")).alias("language"),
    ).where("coalesce(url, '') <> '' and coalesce(title, '') <> ''")


def bluesky_links(spark: SparkSession, path: str, handle: str) -> DataFrame:
    """Own link cards of an account: no reposts, an external embed with url and title."""
    post = "struct<uri:string,record:struct<createdAt:string>,embed:struct<`$type`:string,external:struct<uri:string,title:string,description:string>>>"
    raw = spark.read.option("multiLine", True).schema(f"feed array<struct<reason:struct<`$type`:string>,post:{post}>>").json(path)
    posts = raw.select(F.explode("feed").alias("f")).where("f.reason is null")
    external = F.col("f.post.embed.external")
    key = F.regexp_extract("f.post.uri", r"([^/]+)$", 1)
    return posts.select(
        external["uri"].alias("url"), external["title"].alias("title"), external["description"].alias("snippet"),
        F.concat(F.lit(f"https://bsky.app/profile/{handle}/post/"), key).alias("post_url"), F.col("f.post.record.createdAt").alias("created"),
    ).where("coalesce(url, '') <> '' and coalesce(title, '') <> ''")


def mastodon_links(spark: SparkSession, path: str) -> DataFrame:
    """Statuses with a link card."""
    raw = spark.read.option("multiLine", True).schema("url string, created_at string, reblog struct<id:string>, card struct<url:string,title:string,description:string>").json(path)
    return raw.where("card.url is not null and card.title <> '' and reblog is null").select(F.col("card.url").alias("url"), F.col("card.title").alias("title"), F.col("url").alias("post_url"), "created_at")


#: Language names of the news search and their codes.
LANGUAGES = {
    "arabic": "ar", "chinese": "zh", "dutch": "nl", "english": "en", "french": "fr", "german": "de", "hebrew": "he", "hindi": "hi",
    "italian": "it", "japanese": "ja", "korean": "ko", "portuguese": "pt", "russian": "ru", "spanish": "es", "turkish": "tr", "ukrainian": "uk",
}


def language_code(name: Column) -> Column:
    """Code of a language name in any case; null if unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.lower(F.trim(name)))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, title_a, title_b, same_story, cross_language): title pairs for calibration from JSON lines; not across languages unless stated."""
    raw = spark.read.schema("id string, title_a string, title_b string, same_story boolean, cross_language boolean").json(path)
    return raw.where("id is not null and title_a is not null and title_b is not null and same_story is not null").withColumn("cross_language", F.coalesce("cross_language", F.lit(False)))


def compact_time(text: Column) -> Column:
    """``20240102T030405Z`` as a timestamp; null if malformed."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmssX"))


def first_image(media: Column, thumbnail: Column, enclosure: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (media, thumbnail, enclosure)))


def authors(names: Column, single: Column) -> Column:
    """Trimmed author list without empty names; the single author if there is no list."""
    clean = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    return F.coalesce(F.when(F.size(clean) > 0, clean), F.when(F.coalesce(F.trim(single), F.lit("")) != "", F.array(F.trim(single))))


def account_parts(url: Column) -> tuple[Column, Column]:
    """Instance and handle of an account URL."""
    return F.regexp_extract(url, r"^https?://([^/]+)/@?[^/?]+", 1), F.regexp_extract(url, r"^https?://[^/]+/@?([^/?]+)", 1)


def ads_lines(files: DataFrame) -> DataFrame:
    """(domain, exchange, account, relation): distinct seller lines of ads.txt files."""
    lines = files.select("domain", F.explode(F.split("text", r"\r?\n")).alias("line"))
    bare = F.trim(F.regexp_replace("line", r"#.*$", ""))
    fields = F.transform(F.split(bare, ","), lambda x: F.trim(x))
    rows = lines.where(~bare.rlike(r"^[A-Za-z]+\s*=")).select("domain", fields.alias("f")).where(F.size("f") >= 3)
    out = rows.select("domain", F.lower(F.col("f")[0]).alias("exchange"), F.col("f")[1].alias("account"), F.lower(F.col("f")[2]).alias("relation"))
    return out.where(F.col("exchange").contains(".") & (F.col("account") != "") & F.col("relation").isin("direct", "reseller")).distinct()


#: The declared commitments of a news organisation's markup, the types that may declare them, and where further nodes stand.
COMMITMENTS = [
    "actionableFeedbackPolicy", "correctionsPolicy", "diversityPolicy", "diversityStaffingReport", "ethicsPolicy", "masthead", "noBylinesPolicy",
    "ownershipFundingInfo", "unnamedSourcesPolicy", "verificationFactCheckingPolicy",
]
ORGANISATIONS = ["corporation", "newsmediaorganization", "newspaper", "organization"]
BELOW = ["@graph", "publisher", "parentOrganization", "sourceOrganization"]


def _at(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f'$["{name}"]', "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _listed(value: Column) -> Column:
    """A list's members, else the value itself; none for a missing one."""
    return F.when(value.isNull(), F.array().cast("array<variant>")).when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def _told(value: Column) -> Column:
    """First text of a value: a string, an object's url, @id or name, or what the first member of a list tells that tells anything."""
    text = lambda v: F.when(_is(v, "STRING"), F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))
    tells = lambda v: F.coalesce(text(v), *(F.when(_is(v, "OBJECT"), text(_at(v, key))) for key in ("url", "@id", "name")))
    members = F.flatten(F.transform(_listed(value), _listed))
    return F.get(F.array_compact(F.transform(members, tells)), 0)


def trust_markup(pages: DataFrame) -> DataFrame:
    """(domain, commitments, score, name, founded, publisher) from the JSON-LD blocks of pages (domain, html).

    Nodes are objects in lists of any depth, and under ``BELOW`` of other
    nodes, step by step to any depth; a step's nodes are written to shared
    storage. Organisations are nodes with one of ``ORGANISATIONS`` among their
    types; a commitment counts where its text starts with http. Of several
    names the first in the order of the markup stays. Broken blocks are none.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession, "markup")
    blocks = pages.select("domain", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))).alias("at", "block"))
    level = blocks.select("domain", F.array("at").alias("place"), F.try_parse_json(F.trim("block")).alias("node")).where("node is not null")
    steps = []
    while True:
        level.write.parquet(f"{path}/{len(steps)}")
        level = spark.read.parquet(f"{path}/{len(steps)}")
        if level.isEmpty():
            break
        steps.append(level)
        members = F.when(_is(F.col("node"), "ARRAY"), _listed(F.col("node"))).when(_is(F.col("node"), "OBJECT"), F.array(*(_at(F.col("node"), key) for key in BELOW)))
        level = level.select("domain", "place", F.posexplode(members).alias("at", "node")).where("node is not null").select("domain", F.concat("place", F.array("at")).alias("place"), "node")
    columns = ["name", "founded", "publisher"]
    if not steps:
        return pages.select("domain").distinct().select("domain", F.lit(None).cast("array<string>").alias("commitments"), F.lit(0).cast("long").alias("score"), *(F.lit(None).cast("string").alias(c) for c in columns))
    nodes = steps[0]
    for step in steps[1:]:
        nodes = nodes.unionByName(step)
    node = F.col("node")
    kinds = F.transform(_listed(_at(node, "@type")), lambda t: F.lower(F.when(_is(t, "STRING"), F.try_variant_get(t, "$", "string"))))
    held = nodes.where(_is(node, "OBJECT")).where(F.exists(kinds, lambda t: F.coalesce(t.isin(ORGANISATIONS), F.lit(False))))
    stated = F.array_compact(F.array(*(F.when(F.coalesce(_told(_at(node, c)).startswith("http"), F.lit(False)), c) for c in COMMITMENTS)))
    told = held.select("domain", "place", stated.alias("stated"), *(_told(_at(node, key)).alias(c) for c, key in zip(columns, ("name", "foundingDate", "parentOrganization"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    names = told.groupBy("domain").agg(*(first(c) for c in columns))
    found = told.select("domain", F.explode("stated").alias("c")).distinct().groupBy("domain").agg(F.array_sort(F.collect_list("c")).alias("commitments"), F.count("*").alias("score"))
    whole = pages.select("domain").distinct().join(found, "domain", "left").join(names, "domain", "left")
    return whole.withColumn("score", F.coalesce("score", F.lit(0).cast("long"))).select("domain", "commitments", "score", *columns)


def feed_links(pages: DataFrame) -> DataFrame:
    """(url, feed): distinct absolute addresses of the RSS and Atom feeds that pages (url, html) declare as alternates."""
    attribute = lambda name: F.trim(F.regexp_extract("tag", rf"""(?i)\s{name}\s*=\s*["']?([^"'>]*)""", 1))
    tags = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<link\s[^>]*>)"), F.lit(1))).alias("tag"))
    feeds = tags.where(attribute("rel").rlike(r"(?i)(^|\s)alternate(\s|$)") & attribute("type").rlike(r"(?i)^application/(rss|atom)\+xml"))
    href, scheme = tokens.unescape(attribute("href")), F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin, folder = F.regexp_extract("url", r"^([^:/]+://[^/?#]+)", 1), F.regexp_extract("url", r"^([^:/]+://[^/?#]+(?:/[^?#]*(?=/))?)", 1)
    absolute = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )
    return feeds.where(href != "").select("url", absolute.alias("feed")).where(F.col("feed").rlike("^(?i)https?://")).distinct()


def claims(entities: DataFrame, allowed: DataFrame, most: int = 8) -> DataFrame:
    """(entity, property, target, from_year, to_year): allow-listed claims, the first ``most`` of each property."""
    snak = "array<struct<datavalue:struct<value:struct<time:string>>>>"
    claim = f"array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>,qualifiers:map<string,{snak}>>>"
    parsed = entities.select("entity", F.explode(F.from_json("claims", f"map<string,{claim}>")).alias("property", "values"))
    each = parsed.join((allowed), "property").select("entity", "property", F.posexplode("values").alias("pos", "c"))  # a fixed allow-list
    year = lambda p: F.try_element_at(F.col("c.qualifiers"), F.lit(p))[0]["datavalue"]["value"]["time"]
    out = each.select("entity", "property", "pos", F.col("c.mainsnak.datavalue.value.id").alias("target"), *(F.regexp_extract(year(p), r"([0-9]{4})", 1).try_cast("int").alias(n) for p, n in (("P580", "from_year"), ("P582", "to_year"))))
    order = Window.partitionBy("entity", "property").orderBy("pos")
    return out.where("target is not null").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn", "pos")


def labelled(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Claims with the target's label: Italian, else English, else the identifier."""
    return facts.join(labels.withColumnRenamed("id", "target"), "target", "left").withColumn("label", F.coalesce("it", "en", "target")).drop("it", "en")


def owner_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("property", "label", "from_year", "to_year"))).alias("facts"))


def public_profile(outlets: DataFrame, ads: DataFrame, trust: DataFrame, captures: DataFrame) -> DataFrame:
    """One profile for each outlet domain: ad networks, direct accounts, lines, commitments, first archived copy."""
    sellers = ads.groupBy("domain").agg(F.countDistinct("exchange").alias("networks"), F.count_if(F.col("relation") == "direct").alias("direct"), F.count("*").alias("lines"))
    first = captures.groupBy("domain").agg(F.to_date(F.min("ts")).alias("first_copy"))
    return outlets.join(sellers, "domain", "left").join(trust, "domain", "left").join(first, "domain", "left")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signals after a run: the same (outlet, type, axis, period) is replaced, null axes match; other periods stay."""
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in ("outlet_id", "type", "axis", "period_end"))).distinct()
    same = (F.col("outlet_id") == F.col("n_outlet_id")) & (F.col("type") == F.col("n_type")) & F.col("axis").eqNullSafe(F.col("n_axis")) & (F.col("period_end") == F.col("n_period_end"))
    return old.join(n, same, "left_anti").unionByName(new)


def retitle(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows with an empty snippet take another title and the snippet that the feed brings for their URL."""
    i = incoming.select(F.col("url"), F.col("title").alias("new_title"), F.col("snippet").alias("new_snippet"), F.col("image").alias("new_image"))
    joined = stored.join(i, "url", "left")
    hit = (F.coalesce("snippet", F.lit("")) == "") & F.col("new_title").isNotNull() & (F.col("new_title") != F.col("title"))
    return joined.select("url", F.when(hit, F.col("new_title")).otherwise(F.col("title")).alias("title"), F.when(hit, F.col("new_snippet")).otherwise(F.col("snippet")).alias("snippet"), F.when(hit, F.coalesce("image", "new_image")).otherwise(F.col("image")).alias("image"), hit.alias("retitled"))


def backfill_titles(articles: DataFrame, provenance: DataFrame, method: str) -> DataFrame:
    """Titles of one ingest method cleaned, by semi-join on provenance; all others as they are."""
    mine = provenance.where(F.col("method") == method).select(F.col("entity_id").alias("article_id")).distinct().withColumn("mine", F.lit(True))
    return articles.join(mine, "article_id", "left").withColumn("title", F.when(F.col("mine"), tokens.tidy_title(F.col("title"))).otherwise(F.col("title"))).drop("mine")


def carry_entity_ids(new: DataFrame, previous: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recomputed story entities keep known identifiers; unlinked labels take their first candidate."""
    first = candidates.groupBy("label").agg(F.min_by("qid", "rank").alias("candidate"))
    return new.join(previous.select("story", "label", "qid"), ["story", "label"], "left").join(first, "label", "left").select("story", "label", F.coalesce("qid", "candidate").alias("qid"))


def summary_for(stories: DataFrame, locale: str, fallbacks: list[str]) -> DataFrame:
    """Summary in the reader's language, else the first fallback that exists."""
    choices = [F.try_element_at("summaries", F.lit(x)) for x in [locale, *fallbacks]]
    return stories.select("story", F.coalesce(*choices).alias("summary"), choices[0].isNotNull().alias("own_language"))


def merge_translations(stories: DataFrame, made: DataFrame) -> DataFrame:
    """Translation cache: only missing targets are added; output equal to the title is kept as an empty mark."""
    new = made.join(stories.select("story", "title"), "story").withColumn("text", F.when(F.col("text") == F.col("title"), "").otherwise(F.col("text")))
    add = new.groupBy("story").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "text")))).alias("add"))
    empty = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    old = F.coalesce("translations", empty)
    fresh = F.map_filter(F.coalesce("add", empty), lambda k, v: ~F.map_contains_key(old, k))
    return stories.join(add, "story", "left").withColumn("translations", F.map_concat(old, fresh)).drop("add")

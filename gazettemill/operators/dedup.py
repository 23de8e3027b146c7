"""Article identity: fingerprints, near-duplicates within an outlet, known URLs, outlet domains."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..session import shared_dir


def simhash(articles: DataFrame, text: str = "full_text", size: int = 2) -> DataFrame:
    """(article_id, outlet, fp): 64-bit SimHash over word pairs weighted by frequency; 0 without pairs.

    Each bit has a count of its own in the partial aggregates, so texts may have any length.
    """
    pairs = articles.select("article_id", F.explode(T.shingles(T.words(F.col(text)), size)).alias("s"))
    high, low = T.md5_halves(F.col("s"))
    hashed = pairs.select("article_id", F.shiftleft(high, 32).bitwiseOR(low).alias("h"))
    fp = F.lit(0).cast("long")
    for bit in range(64):
        ones = F.sum(F.shiftrightunsigned("h", bit).bitwiseAND(F.lit(1)))
        fp = fp.bitwiseOR(F.when(2 * ones > F.count("*"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    found = hashed.groupBy("article_id").agg(fp.alias("fp"))
    return articles.select("article_id", "outlet").join(found, "article_id", "left").withColumn("fp", F.coalesce("fp", F.lit(0).cast("long")))


def _stored(prints: DataFrame, path: str) -> DataFrame:
    """``prints`` written below ``path`` and read back, for rules that read them several times: texts are hashed once."""
    prints.write.parquet(f"{path}/prints")
    return prints.sparkSession.read.schema(prints.schema).parquet(f"{path}/prints")


def hexadecimal(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_pairs(prints: DataFrame, distance: int = 3, within: list[str] | None = None) -> DataFrame:
    """(a, b, distance) of different fingerprints up to ``distance`` bits apart, by their classes' smallest article.

    Pigeonhole: of ``distance`` + 2 blocks of bits at least two are equal, so
    articles join on each pair of blocks (26 bits for distance 3, few chance
    meetings) and are verified. Equal fingerprints are one class; copies never
    form pairs.
    """
    within = within or []
    classes = prints.groupBy(*within, "fp").agg(F.min("article_id").alias("article_id"))
    edges = [64 * i // (distance + 2) for i in range(distance + 3)]
    blocks = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = [F.shiftleft(blocks[i], 32).bitwiseOR(blocks[j]) for i in range(len(blocks)) for j in range(i)]
    bands = classes.select(*within, "article_id", "fp", F.posexplode(F.array(*keys)).alias("band", "value"))
    left = bands.select(*within, "band", "value", F.col("article_id").alias("a"), F.col("fp").alias("fa"))
    right = bands.select(*within, "band", "value", F.col("article_id").alias("b"), F.col("fp").alias("fb"))
    d = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    return left.join(right, [*within, "band", "value"]).where("a < b").select(*within, "a", "b", d.cast("int").alias("distance")).where(F.col("distance") <= distance).distinct()


def latest_prints(prints: DataFrame, limit: int = 300) -> DataFrame:
    newest = Window.partitionBy("outlet").orderBy(F.desc("article_id"))
    return prints.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit).drop("rn")


def repeats_in_outlet(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Articles with an earlier near-duplicate in their outlet (equal fingerprints included)."""
    prints = _stored(prints, shared_dir(prints.sparkSession, "repeats"))
    first = F.min("article_id").over(Window.partitionBy("outlet", "fp"))
    copies = prints.withColumn("first", first).where("article_id > first").select("article_id", "outlet")
    near = near_pairs(prints, distance, ["outlet"]).select(F.col("b").alias("article_id"), "outlet")
    return copies.union(near).distinct()


def greedy_keep(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Sequential rule: an article stays unless near a kept earlier one of its outlet, however long ago.

    Decided in rounds of joins on the near pairs. Articles without an undecided earlier neighbour stay, their
    later neighbours go, and pairs of decided articles leave the table; the smallest article of what remains is
    decided in every round, and the rounds are as many as the longest chain of neighbours that decide each other.
    The prints and every round are written to the shared folder. Copies of one fingerprint follow their first article.
    """
    spark, path = prints.sparkSession, shared_dir(prints.sparkSession, "greedy")
    prints = _stored(prints, path)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    pairs, turn = written(near_pairs(prints, distance, ["outlet"]).select("a", "b"), "pairs-0"), 0
    dropped = pairs.select(F.col("b").alias("article_id")).limit(0)
    while not pairs.isEmpty():
        turn += 1
        kept = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = written(pairs.join(kept, "a", "left_semi").select(F.col("b").alias("article_id")).distinct(), f"gone-{turn}")
        dropped = dropped.union(gone)
        rest = pairs.join(kept, "a", "left_anti")
        for end in ("a", "b"):
            rest = rest.join(gone.withColumnRenamed("article_id", end), end, "left_anti")
        pairs = written(rest.select("a", "b"), f"pairs-{turn}")
    first = F.min("article_id").over(Window.partitionBy("outlet", "fp"))
    marked = prints.withColumn("copy", F.col("article_id") > first).join(dropped.withColumn("gone", F.lit(True)), "article_id", "left")
    return marked.select("article_id", "outlet", (~F.col("copy") & F.col("gone").isNull()).alias("kept"))


def _recent(distance: int, limit: int):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        """The slice's articles of an outlet in order, after the kept ones carried into it (``carried``)."""
        pdf = pdf.sort_values(["carried", "article_id"], ascending=[False, True])
        prints, ids, carried = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["article_id"].to_numpy(), pdf["carried"].to_numpy()
        window = np.zeros(len(pdf), np.uint64)  # kept prints, the latest last
        last, kept = 0, np.zeros(len(pdf), bool)
        for i, fp in enumerate(prints):
            near = not carried[i] and (np.bitwise_count(window[max(0, last - limit) : last] ^ fp) <= distance).any()
            if not near:
                window[last], kept[i], last = fp, True, last + 1
        return pd.DataFrame({"outlet": pdf["outlet"].iat[0], "article_id": ids, "fp": pdf["fp"], "carried": carried, "kept": kept})

    return decide


def keep_recent(prints: DataFrame, distance: int = 3, limit: int = 300, slice_rows: int = 1_000_000) -> DataFrame:
    """(article_id, outlet, kept): an article stays unless near one of the ``limit`` latest kept articles of its outlet.

    The decision is sequential in an outlet. The table is cut into slices of
    about ``slice_rows`` by article_id; in a slice each outlet is one group, so a task
    holds an outlet's share of one slice. The last ``limit`` kept prints of
    every outlet are carried to the next slice in a written table.
    """
    spark, path = prints.sparkSession, shared_dir(prints.sparkSession, "recent")
    shape = "outlet string, article_id long, fp long, carried boolean, kept boolean"
    prints = prints.select(F.col("outlet").cast("string").alias("outlet"), F.col("article_id").cast("long").alias("article_id"), "fp", F.lit(False).alias("carried"))
    prints = _stored(prints, path)
    slices = max(1, -(-prints.count() // slice_rows))
    cuts = sorted(set(prints.approxQuantile("article_id", [k / slices for k in range(1, slices)], 0.1 / slices))) if slices > 1 else []
    newest = Window.partitionBy("outlet").orderBy(F.desc("article_id"))
    carried, done = None, []
    for turn, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = prints if low is None else prints.where(F.col("article_id") >= int(low))
        part = part if high is None else part.where(F.col("article_id") < int(high))
        rows = part if carried is None else part.unionByName(carried)
        rows.groupBy("outlet").applyInPandas(_recent(distance, limit), shape).write.parquet(f"{path}/{turn}")
        out = spark.read.schema(shape).parquet(f"{path}/{turn}")
        done.append(out.where("not carried"))
        carried = out.where("kept").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit).select("outlet", "article_id", "fp", F.lit(True).alias("carried"))
    return functools.reduce(DataFrame.unionByName, done).select("article_id", "outlet", "kept")


_STATUS = ["created", "existing", "duplicate"]


def _decided(distance: int, limit: int):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        """Items of an outlet in the feed's order, after its stored prints (place null)."""
        stored = pdf[pdf["place"].isna()].sort_values("article_id")["fp"].to_numpy(np.int64).view(np.uint64).tolist()
        items = pdf[pdf["place"].notna()].sort_values("place")
        window, created, status = np.array(stored[-limit:] + [0] * len(items), np.uint64), set(), []
        last = len(stored[-limit:])
        for canonical, known, fp in zip(items["canonical"], items["known"], items["fp"].to_numpy(np.int64).view(np.uint64)):
            if known or canonical in created:
                status.append("existing")
            elif (np.bitwise_count(window[:last] ^ fp) <= distance).any():
                status.append("duplicate")
            else:
                status.append("created")
                created.add(canonical)
                window[last] = fp
                last += 1
        return pd.DataFrame({"outlet": items["outlet"], "place": items["place"].astype("int64"), "status": status})

    return decide


def ingest(incoming: DataFrame, stored: DataFrame, distance: int = 3, limit: int = 300) -> DataFrame:
    """A run's feed items with their fate: (outlet, place, url, canonical, title, snippet, status, retitled).

    ``incoming`` holds outlet, place (order in the outlet's feed), url, title and snippet, ``stored`` article_id,
    outlet, url, title and snippet. An item is existing if its URL or canonical URL is stored, or was created
    earlier in the run; then a stored row without snippet takes its other title (retitled). Else it is a
    duplicate if near one of the outlet's ``limit`` latest stored prints or one created in the run, else created.
    Only an outlet's items of one run and ``limit`` stored prints meet in a task.
    """
    items = incoming.select("outlet", F.col("place").cast("long").alias("place"), "url", T.canonical_url(F.col("url")).alias("canonical"), "title", "snippet")
    old = stored.select("url", T.canonical_url(F.col("url")).alias("canonical"), F.col("title").alias("old_title"), (F.coalesce(F.trim("snippet"), F.lit("")) == "").alias("bare"))
    first = lambda key: old.groupBy(key).agg(F.min(F.struct("old_title", "bare")).alias(f"by_{key}"))
    seen = items.join(first("url"), "url", "left").join(first("canonical"), "canonical", "left").withColumn("old", F.coalesce("by_url", "by_canonical"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text")
    key = F.concat_ws("\u0001", "outlet", F.col("place").cast("string"))
    prints = simhash(seen.select(key.alias("article_id"), "outlet", text), "text").select(F.col("article_id").alias("key"), "fp")
    new = seen.withColumn("key", key).join(prints, "key").select("outlet", "place", "canonical", F.col("old").isNotNull().alias("known"), "fp", F.lit(None).cast("long").alias("article_id"))
    latest = latest_prints(stored.select("article_id", "outlet", "title", "snippet"), limit)
    kept = simhash(latest.select("article_id", "outlet", text), "text").select("outlet", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("canonical"), F.lit(True).alias("known"), "fp", F.col("article_id").cast("long").alias("article_id"))
    fate = new.unionByName(kept.join(items.select("outlet").distinct(), "outlet", "left_semi")).groupBy("outlet").applyInPandas(_decided(distance, limit), "outlet string, place long, status string")
    retitled = F.coalesce(F.col("old.bare") & (F.col("title") != F.col("old.old_title")) & (F.col("title") != ""), F.lit(False))
    return seen.join(fate, ["outlet", "place"]).select("outlet", "place", "url", "canonical", "title", "snippet", "status", retitled.alias("retitled"))


def ingest_counts(items: DataFrame) -> DataFrame:
    """(outlet, fetched, created, existing, duplicate, retitled) of a run's items."""
    return items.groupBy("outlet").agg(F.count("*").alias("fetched"), *(F.count_if(F.col("status") == s).alias(s) for s in _STATUS), F.count_if("retitled").alias("retitled"))


def with_language(items: DataFrame, guesses: DataFrame, outlets: DataFrame) -> DataFrame:
    """Items with the language found in their text (outlet, place, detected), else their outlet's (outlet, language)."""
    joined = items.join(guesses, ["outlet", "place"], "left").join(outlets.select("outlet", F.col("language").alias("own")), "outlet", "left")
    return joined.withColumn("language", F.coalesce("detected", "own")).drop("detected", "own")


def unknown(incoming: DataFrame, stored: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """Incoming rows whose URL and canonical URL aren't stored, the first of each canonical URL."""
    new = incoming.withColumn("canonical", T.canonical_url(F.col(url)))
    old = stored.select(F.col(url).alias("known"), T.canonical_url(F.col(url)).alias("known_canonical"))
    new = new.join(old, new[url] == old["known"], "left_anti").join(old.select("known_canonical").distinct(), F.col("canonical") == F.col("known_canonical"), "left_anti")
    first = Window.partitionBy("canonical").orderBy(order)
    return new.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def own_links(cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """Link cards (handle, url) that lead to the account's own outlet: verified accounts (handle, domain, verified), the domain itself or one below it."""
    where = F.regexp_replace(T.host(F.col("url")), r"^www\.", "")
    own = F.lower(F.regexp_replace("domain", r"^www\.", ""))
    joined = cards.withColumn("key", F.lower(F.ltrim("handle", F.lit("@")))).join(accounts.where("verified").select(F.lower(F.ltrim("handle", F.lit("@"))).alias("key"), "domain"), "key")
    return joined.where((where == own) | where.endswith(F.concat(F.lit("."), own))).drop("key")


def attribute(pages: DataFrame, outlets: DataFrame) -> DataFrame:
    """(page_id, domain): the outlet whose domain is the page's host or its longest dot-suffix, by equi-join on suffixes."""
    labels = F.split(F.regexp_replace(T.host(F.col("url")), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = pages.select("page_id", F.posexplode(suffixes).alias("depth", "domain"))
    return each.join(outlets.select("domain").distinct(), "domain").groupBy("page_id").agg(F.min_by("domain", "depth").alias("domain"))

"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the three base kinds (assign, access, hex) and long mixed
tokens of no known form. Every candidate value is counted over the corpus by
distinct owners (``source``) and distinct repositories (``doc_id``): a value
that ``widely`` or more owners hold is a copied example, any other is
owner-specific and looks live. Base spans always stay; a mixed token becomes
an added span (kind ``owned``) only if it is owner-specific and apart from the
base spans of its document.

Positions are code points. They come from the texts between matches:
``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping
matches, so lengths add up to offsets.

Null text counts as empty; a null source is one owner of its own and a null
doc_id one repository. Repeated rows are scanned each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The base patterns; the kind's order breaks ties of start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: str, pattern: str, kind: int, group: int, maybe: F.Column) -> F.Column:
    """Spans of all matches; texts that fail ``maybe`` are passed over."""
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = F.expr(f"""
        aggregate(
          arrays_zip(split({text}, '{escaped}', -1), regexp_extract_all({text}, '{escaped}', 0), regexp_extract_all({text}, '{escaped}', {group})),
          named_struct('at', 0, 'out', cast(array() as {_SPANS})),
          (acc, x) -> named_struct(
            'at', acc.at + length(x['0']) + coalesce(length(x['1']), 0),
            'out', if(x['1'] is null, acc.out, concat(acc.out, array(named_struct(
              'start', acc.at + length(x['0']), 'kind', {kind}, 'end', acc.at + length(x['0']) + length(x['1']), 'value', x['2']))))),
          acc -> acc.out)""")
    return F.when(maybe, found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _written(spans: str) -> F.Column:
    names = "element_at(array('assign','access','hex','owned'), s.kind + 1)"
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', {names}, s.start, s.end)), ',')")


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, base, mixed): spans of every text, written to the shared folder."""
    t = F.col("text")
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        common.text_or_empty().alias("text"),
    )
    scanned = texts.select(
        "row", "doc_id", "source",
        F.filter(_spans("text", ASSIGN, 0, 2, (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        _spans("text", ACCESS, 1, 0, t.contains("AKIA")).alias("access"),
        _spans("text", HEX, 2, 0, t.rlike(HEX)).alias("hex"),
        F.filter(
            _spans("text", MIXED, 3, 0, t.rlike(r"[0-9]") & t.rlike(MIXED)),
            lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"),
        ).alias("mixed"),
    )
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("value")))
    return common.cut(scanned.select("row", "doc_id", "source", hashed(F.concat("assign", "access", "hex")).alias("base"), hashed(F.col("mixed")).alias("mixed")), "candidates")


def ownership(found: DataFrame, widely: int = 3) -> DataFrame:
    """(value, n_repositories, n_owners, example) of each candidate value, by its hash.

    Values are first reduced to distinct (value, owner) and (value, owner,
    repository) rows with partial aggregates, so a value in a third of all
    documents is no hot key.
    """
    each = found.select("doc_id", "source", F.explode(F.concat("base", "mixed")).alias("s")).select(F.col("s.value").alias("value"), "source", "doc_id")
    by_owner = each.distinct().groupBy("value", "source").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners")).withColumn("example", F.col("n_owners") >= widely)


def scan(docs: DataFrame, widely: int = 3) -> DataFrame:
    """(doc_id, base, added, n_live, n_example) of every document.

    ``base`` and ``added`` are arrays of (start, kind, end, value hash); the
    counts class all of them by the ownership of their value.
    """
    found = candidates(docs)
    verdict = common.cut(ownership(found, widely).select("value", "example", "n_repositories"), "verdict")
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = found.select("row", F.explode(F.concat("base", F.filter("mixed", apart))).alias("s"))
    judged = common.weighted_join(spans.withColumn("value", F.col("s.value")), verdict, ["value"], "n_repositories")
    kept = judged.where("s.kind < 3 or not example").groupBy("row").agg(
        F.collect_list(F.when(F.col("s.kind") == 3, F.col("s"))).alias("added"),
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if(F.col("example")).alias("n_example"),
    )
    out = found.select("row", "doc_id", "base").join(kept, "row", "left")
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return out.select("doc_id", "base", F.coalesce("added", empty).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``: base spans hashed, all spans written out."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return scanned.withColumn("everything", F.concat("base", "added")).select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("everything").alias("spans"),
        "n_live", "n_example",
    )

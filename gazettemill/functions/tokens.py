"""Column functions on text: tokens, n-grams, canonical URLs, titles, snippets."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token contract: words, and each punctuation mark by itself; alike in Spark and DuckDB.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"

#: Query parameters that only track, by name and by prefix.
TRACKING_NAMES = [
    "at_campaign", "at_medium", "cmp", "cmpid", "dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ns_campaign", "ns_linkname",
    "ns_mchannel", "ns_source", "ocid", "ref_src", "s_kwcid", "share", "smid", "spm", "src", "twclid", "wt_mc", "xtor",
]
TRACKING_PREFIXES = ["mtm_", "piwik_", "pk_", "utm_"]

#: Country names that a news search writes in lower case, and their repair.
COUNTRY_FIXES = {
    "united arab emirates": "United Arab Emirates", "czech republic": "Czech Republic", "united kingdom": "UK", "united states": "USA", "south africa": "South Africa",
    "saudi arabia": "Saudi Arabia", "south korea": "South Korea", "north korea": "North Korea", "new zealand": "New Zealand",
}

#: The standard's character references: names with their semicolon, older names that may lack it, and the numbers that mean Windows-1252.
NAMED = {name: text for name, text in html.entities.html5.items() if name.endswith(";")}
BARE = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
CP1252 = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def shingles(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of an array; a shorter array has none. The array is bound once, not evaluated for each n-gram."""
    none = F.array().cast("array<string>")
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)
    return F.transform(F.array(tokens), grams)[0]


def _character(code: Column) -> Column:
    """The character of a numeric reference; what isn't one becomes the replacement character, control codes go."""
    old = F.create_map(*(F.lit(x) for n, c in CP1252.items() for x in (n, c)))
    none = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | code.isin(0x0B) | code.between(0x0E, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    return F.when(none, F.lit("\ufffd")).when(code.between(0x80, 0x9F) & F.map_contains_key(old, code.cast("int")), F.try_element_at(old, code.cast("int"))).when(control, F.lit("")).otherwise(plain)


def unescape(text: Column) -> Column:
    """Character references decoded as browsers do: numbers, names, and older names without a semicolon."""
    known = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    old = F.from_json(F.lit(json.dumps({n: html.entities.html5[n] for n in BARE})), "map<string,string>")

    def decoded(part: Column) -> Column:
        number, hexed = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
        digits = F.ltrim(hexed, F.lit("0"))
        code = F.when(number != "", number.try_cast("long")).when(digits == "", F.lit(0).cast("long")).when(F.length(digits) <= 7, F.conv(digits, 16, 10).try_cast("long"))
        name, bare = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(part, "^(" + "|".join(BARE) + ")", 1)
        after = lambda length: F.substring(part, length + 1, F.length(part))
        numeric = F.concat(_character(code), F.regexp_replace(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", ""))
        return (
            F.when((number != "") | (hexed != ""), numeric).when(F.map_contains_key(known, name), F.concat(F.try_element_at(known, name), after(F.length(name))))
            .when(bare != "", F.concat(F.try_element_at(old, bare), after(F.length(bare)))).otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    rest = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), "")
    return F.when(text.contains("&"), F.concat(parts[0], rest)).otherwise(text)


def canonical_url(url: Column) -> Column:
    """Stable form of a URL: scheme and host lower-cased, default ports, fragment and tracking parameters dropped, query sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^[^@]*@", ""), r":(80|443)?$", "")
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1)
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p != "")
    decoded = F.transform(pairs, lambda p: F.struct(F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.url_decode(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v")))
    tracking = lambda k: F.lower(k).isin(TRACKING_NAMES) | F.lower(k).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.array_sort(F.filter(decoded, lambda p: ~tracking(p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def snippet(markup: Column, limit: int = 200) -> Column:
    """Plain text with single spaces, cut at a word with an ellipsis."""
    text = F.trim(F.regexp_replace(unescape(F.regexp_replace(markup, r"<[^>]*>", " ")), r"\s+", " "))
    cut = F.substring(text, 1, limit - 1)
    at_word = F.when(cut.contains(" "), F.regexp_extract(cut, r"^(.*) ", 1)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(at_word, F.lit("…")))


def tidy_title(title: Column) -> Column:
    """Repairs of a re-tokenised title: countries, slashes, spaces around punctuation and brackets, double spaces."""
    for wrong, right in COUNTRY_FIXES.items():
        title = F.regexp_replace(title, rf"\b{wrong}\b", right)
    title = F.regexp_replace(title, r"(?<=[\p{L}\p{N}_])\s+/\s+(?=[\p{L}\p{N}_])", "/")
    title = F.regexp_replace(title, r"\s+([,.;:!?%)\]])", "$1")
    title = F.regexp_replace(title, r"([(\[])\s+", "$1")
    return F.trim(F.regexp_replace(title, r"\s{2,}", " "))


def strong_words(text: Column) -> Column:
    """Distinct lower-cased names and numbers: capitalised of four letters or more, or two digits or more but no year."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    keep = lambda t: (t.rlike(r"^\p{Lu}") & (F.length(t) >= 4)) | (t.rlike(r"^[0-9]{2,}$") & ~t.rlike(r"^(19|20)[0-9][0-9]$"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, keep), F.lower)))


def same_news(a: Column, b: Column) -> Column:
    """Whether two sets of strong words share a four-character prefix."""
    prefix = lambda x: F.transform(x, lambda t: F.substring(t, 1, 4))
    return F.arrays_overlap(prefix(a), prefix(b))


def strip_think(text: Column) -> Column:
    """Generated text without a leading thinking span; an unclosed one leaves nothing."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*<think>.*?(</think>\n*|$)", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def md5_halves(text: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers from the first 16 hexadecimal digits of the md5."""
    digest = F.md5(text)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")

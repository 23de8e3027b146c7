"""Small dictionaries as dimensions: stop words, topics, framing groups, valence.

They hold words of the languages at hand, written for this package; a site
with other needs passes its own tables to the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STOP_WORDS = {
    "en": "the of and to in is that for it with as was on be at by this from are or an have has not but",
    "fr": "le la les de des du et en un une est que qui dans pour sur par au aux avec pas ce",
    "de": "der die das und ist von den dem mit nicht ein eine zu im auf für als auch sich es",
    "it": "il lo la gli le di del della e che in un una per con non è sono da al dei si come anche più",
    "pt": "o a os as de do da dos das e que em um uma por para com não no na se ao é mais como",
    "nl": "de het een en van in is dat op te voor met niet zijn aan er om ook als bij door naar dan",
    "es": "el la los las de del y que en un una es por con para se su al lo como",
}

TOPICS = [
    ("economy", "en", "ering bleer thand money"), ("politics", "en", "thor heed ander vote"), ("science", "en", "thereon ingthe onan study"),
    ("economy", "de", "ungen lich geld"), ("politics", "de", "keit heit wahl"), ("economy", "fr", "ment tion argent"), ("politics", "es", "ción mente voto"),
]

FRAMES = [("conflict", "en", "heat"), ("conflict", "en", "to the"), ("care", "en", "heal"), ("care", "en", "of the"), ("order", "de", "und die"), ("order", "fr", "de la"), ("order", "es", "de la")]

VALENCE = [("en", "heat", -1.0), ("en", "thand", 0.5), ("en", "the", 0.25), ("en", "stupid", -2.0), ("en", "ering", 1.0), ("fr", "de", 0.5), ("de", "nicht", -1.0), ("es", "para", 0.75)]


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, w) for lang, ws in STOP_WORDS.items() for w in ws.split()], "stop_lang string, word string")


def topics(spark: SparkSession) -> DataFrame:
    """(topic, ordinal, lang, term, total): keywords with the topic's number of keywords."""
    return spark.createDataFrame([(t, i, lang, w, len(ws.split())) for i, (t, lang, ws) in enumerate(TOPICS) for w in ws.split()], "topic string, ordinal int, lang string, term string, total int")


def frames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, lang, t, len(t.split())) for g, lang, t in FRAMES], "grp string, lang string, term string, n_tokens int")


def valence(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VALENCE, "lang string, word string, score double")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v) + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


SQL = {
    "stops": f"SELECT * FROM (VALUES {_values((lang, w) for lang, ws in STOP_WORDS.items() for w in ws.split())}) t(stop_lang, word)",
    "topics": f"SELECT * FROM (VALUES {_values((t, i, lang, w, len(ws.split())) for i, (t, lang, ws) in enumerate(TOPICS) for w in ws.split())}) t(topic, ordinal, lang, term, total)",
    "frames": f"SELECT * FROM (VALUES {_values((g, lang, t, len(t.split())) for g, lang, t in FRAMES)}) t(grp, lang, term, n_tokens)",
    "valence": f"SELECT lang, word, score::DOUBLE AS score FROM (VALUES {_values(VALENCE)}) t(lang, word, score)",
}

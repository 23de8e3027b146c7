"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, ctph, decontam, htmlmain, linededup, ngramjoin, packing, secrets, simhash, suffixdedup, tokenfiles, toxicity, whitening


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"), size=3)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(common.read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2048, 0)
    placed = packed.placed("doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")).drop("evidence")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(common.read(spark, sf_dir, "documents"), 40, 5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixdedup.dedup(common.read(spark, sf_dir, "documents"), 200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_next(common.read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(common.read(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), 0.8)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write(common.read(spark, sf_dir, "documents"), common.shared_dir(spark), _tokenizer("word_bpe_49k.json"), 1)
    return files.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(common.read(spark, sf_dir, "embeddings"), components=4, scale=256))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(common.read(spark, sf_dir, "documents"), size=3, percent=90)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.read(spark, sf_dir, "documents"), least=30, longest=4, contained=80, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_best_fit_packing, op3_toxicity, op4_line_dedup, op5_main_text, op6_repeated_substrings, op7_piecewise_hashes, op8_secret_scan, op9_benchmark_decontamination, op10_token_files, op11_whitening, op12_ngram_jaccard, op13_collocations, pipeline)}


_OP4 = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
 k AS (SELECT *, translate(trim(line, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 d AS (SELECT k.*, coalesce(k.doc_id <> r.last, false) AS gone FROM k LEFT JOIN r USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY 1"""


#: The n-gram sets of texts, links of all pairs that share an n-gram, and the smallest doc_id by repeated minima.
_OP12 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS g FROM w),
 e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.doc_id)
 SELECT s.doc_id, len(s.g) AS n_shingles, m.root AS component_id FROM s JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY 1) m USING (doc_id)"""

_OP13 = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(ws) >= k),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
 x AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS one, array_to_string(ws[k+1:], ' ') AS two FROM c, range(1, 4) r(k) WHERE k < len(ws)),
 y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, (2000000::HUGEINT * x.a) // (l.f + r.f) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = one JOIN f r ON r.lang = x.lang AND r.phrase = two),
 z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 i AS (SELECT lang, a, unnest(list_transform(range(1, len(ws) - m + 2), lambda j: array_to_string(ws[j:j+m-1], ' '))) AS phrase FROM c, range(2, 4) r(m) WHERE m < len(ws)),
 o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY 1, 2),
 q AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
 SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Line dedup, n-gram links and phrases are plain SQL; the others' hashes, tokenisers, models, trees and match positions are not."""
    return {"op4_line_dedup": _OP4, "op12_ngram_jaccard": _OP12, "op13_collocations": _OP13}

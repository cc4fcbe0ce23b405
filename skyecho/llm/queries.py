"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyecho.llm import ann, bpe, langid, linededup, lzprint, ngramjoin, packing, pii, quality, warc
from skyecho.llm.common import held_out, scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs, ~held_out())
    return langid.identify(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    scored = quality.score(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.with_targets(warc.captures(warc.assemble(warc.read(spark, path))))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.with_edits(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def pii_key(spark: SparkSession) -> str:
    """The key of the setting spark.skyecho.pii.key. The synthetic tables hold nobody's data: for them, and for them only, an
    open one stands in where it isn't set."""
    return spark.conf.get("spark.skyecho.pii.key", None) or "open"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.apply(_documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_quality, op3_warc, op4_fingerprint, op5_packing, op6_line_dedup, op7_ann, op8_bpe, op9_pii, op10_ngram_join)}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op6_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, no, line, list_sort(list_distinct(list_filter(string_split(lower(translate(line, chr(9) || chr(13), '  ')), ' '), lambda x: x <> ''))) AS words FROM l),
        u AS (SELECT row_number() OVER (ORDER BY words) AS id, words, len(words) AS n, min((doc_id, no)) AS place FROM w WHERE len(words) > 0 GROUP BY words),
        e AS (SELECT id, n, unnest(words) AS word FROM u),
        o AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY count, word) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY word) AS count FROM e)),
        p AS (SELECT * FROM o WHERE 100 * (n - pos + 1) >= 80 * n),
        c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        m AS (SELECT c.a AS id, min(y.place) AS place FROM c JOIN u x ON c.a = x.id JOIN u y ON c.b = y.id
            WHERE 100 * len(list_intersect(x.words, y.words)) >= 80 * (x.n + y.n - len(list_intersect(x.words, y.words))) GROUP BY 1),
        first AS (SELECT u.words AS words, least(u.place, coalesce(m.place, u.place)) AS place FROM u LEFT JOIN m ON u.id = m.id),
        marked AS (SELECT w.doc_id, w.no, w.line, coalesce((w.doc_id, w.no) > first.place, false) AS gone FROM w LEFT JOIN first ON w.words = first.words),
        g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed FROM marked GROUP BY 1)
        SELECT d.doc_id, g.text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
        reach(v, u) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.u = links.a)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT v, min(u) AS component_id FROM reach GROUP BY 1) r ON s.doc_id = r.v""",
}

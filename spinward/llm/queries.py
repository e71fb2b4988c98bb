"""The queries of the training-data operators, each over its whole table; ORACLE has SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.llm import bpe, decontaminate, imatch, jaccard, licenses, quality, secrets, token_counts, urls, warc
from spinward.llm.common import table

RULES = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"), urls.Rule("block", "example.net/de/8"), urls.Rule("block", "org/es/")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train_markov(secrets.labelled_samples(spark))
    found = secrets.secret_spans(documents(spark, sf_dir), model)

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return imatch.compare_neighbours(docs, imatch.fit_lexicon(docs))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.license_scan(docs, licenses.fit_licenses(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, RULES, urls.fit_urls(pages, RULES))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)

    def page(c: str):
        return F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1)

    return read.select(F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").cast("long").alias("refers_to"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_fingerprints, op4_license_scan, op5_decontaminate, op6_url_filter, op7_quality, op8_warc, op9_jaccard_join, op10_byte_bpe)}

_TEMPLATES = ", ".join(f"({i}, '{lic}', '{text}')" for i, (lic, text) in enumerate(licenses.TEMPLATES))

ORACLE: dict[str, str] = {
    "op4_license_scan": f"""
        WITH tpl(i, license, text) AS (VALUES {_TEMPLATES}),
        tw AS (SELECT i, license, w, count(*) AS tf FROM (SELECT i, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM tpl) GROUP BY ALL),
        total AS (SELECT count(*) AS n FROM documents),
        df AS (SELECT w, count(*) AS k FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents) WHERE w IN (SELECT w FROM tw) GROUP BY w),
        idf AS (SELECT w, ln((n + 1) / (coalesce(k, 0) + 1.0)) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), total),
        tn AS (SELECT i, sqrt(sum(pow(tf * idf, 2))) AS norm FROM tw JOIN idf USING (w) GROUP BY i),
        tv AS (SELECT i, license, w, tf * idf / norm AS weight FROM tw JOIN idf USING (w) JOIN tn USING (i)),
        units AS (SELECT doc_id, -1 AS unit, text AS u FROM documents UNION ALL SELECT doc_id, unnest(range(len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) FROM documents),
        uw AS (SELECT doc_id, unit, w, count(*) AS tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(u), '[a-z0-9]+')) AS w FROM units) GROUP BY ALL),
        un AS (SELECT doc_id, unit, sqrt(sum(pow(tf * coalesce(idf, ln(n + 1.0) + 1), 2))) AS norm FROM uw LEFT JOIN idf USING (w), total GROUP BY doc_id, unit),
        dots AS (SELECT doc_id, unit, i, license, sum(tf * idf * weight) AS dot FROM uw JOIN idf USING (w) JOIN tv USING (w) GROUP BY ALL),
        sc AS (SELECT doc_id, unit, license, round(dot / norm, 9) AS score FROM dots JOIN un USING (doc_id, unit) WHERE round(dot / norm, 9) >= 0.6),
        best AS (SELECT doc_id, unit, arg_min(license, (-score, license)) AS license, max(score) AS score FROM sc GROUP BY ALL),
        h AS (SELECT doc_id, arg_min(license, (-score, license)) AS header, max(score) AS header_score FROM best WHERE unit >= 0 GROUP BY doc_id),
        f AS (SELECT doc_id, license AS file, score AS file_score FROM best WHERE unit = -1),
        r AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, header, header_score, file, file_score
            FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)),
        of_dir AS (SELECT dir, arg_min(file, (-file_score, file, path)) AS inherited FROM r WHERE file IS NOT NULL GROUP BY dir)
        SELECT doc_id, path, coalesce(header, file, inherited) AS license, coalesce(header_score, file_score) AS score,
            CASE WHEN header IS NOT NULL THEN 'header' WHEN file IS NOT NULL THEN 'file' WHEN inherited IS NOT NULL THEN 'inherited' END AS how,
            CASE WHEN coalesce(header, file) IS NULL AND inherited IS NOT NULL THEN dir END AS origin
        FROM r LEFT JOIN of_dir USING (dir)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, body, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p),
        bits AS (SELECT *, sha1(body) AS hex FROM d)
        SELECT page_id, payload_bytes,
               list_reduce(list_transform(range(0, 4), lambda k: (
                   list_reduce(list_transform(range(0, 8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + CAST((CAST('0x' || substr(hex, 1 + 10 * k, 10) AS BIGINT) >> (35 - 5 * j)) & 31 AS INT), 1)), lambda a, b: a || b))), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM bits""",
}

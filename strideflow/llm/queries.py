"""Registered queries of the text operators: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideflow.llm import lm
from strideflow.llm.bpe import encode_digests
from strideflow.llm.common import read_table
from strideflow.llm.decontaminate import contaminated
from strideflow.llm.divergence import audit
from strideflow.llm.htmltext import extract
from strideflow.llm.langid import identify
from strideflow.llm.pii import find_pii
from strideflow.llm.quality import judge
from strideflow.llm.secrets import scan_secrets
from strideflow.llm.simhash import near_duplicates
from strideflow.llm.toxicity import score
from strideflow.llm.variants import group_variants
from strideflow.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


@query
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(read_table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), t AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*)::HUGEINT AS n_term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
        ), langs AS (
            SELECT lang, count(*) AS v, sum(n_term) AS n_lang FROM kept GROUP BY lang
        ), counts AS (
            SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), groups AS (
            SELECT DISTINCT lang, source FROM d
        ), totals AS (
            SELECT lang, source, coalesce(sum(n), 0) AS n_group FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
        ), cells AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (n_group + 2 * v) AS p,
                   1 + (1000000000::HUGEINT * (n_term + 2)) // (n_lang + 2 * v) AS q
            FROM totals JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)
        ), pair_sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), every_value AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM cells WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every_value
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
        ), f AS (
            SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    # For pages that mark their article and hold no other element in it but headings, paragraphs, breaks and bold text.
    "op12_html_text": r"""
        WITH a AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages
        ), lines AS (
            SELECT page_id, url, string_split(
                regexp_replace(regexp_replace(regexp_replace(inner_html, '\s+', ' ', 'g'), '</?(p|h1)>|<br><br>', chr(10), 'g'), '<br>', ' ', 'g'), chr(10)
            ) AS parts
            FROM a
        ), decoded AS (
            SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
                regexp_replace(x, '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
            FROM lines
        ), texts AS (
            SELECT page_id, url, coalesce(list_aggregate(list_filter(parts, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text FROM decoded
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM texts
    """,
}

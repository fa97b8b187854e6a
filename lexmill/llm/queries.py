"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import packing

    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "text_license", F.concat_ws(",", "notices").alias("notices"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import neardup

    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import mixing

    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), ann.train(vectors))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm import lm

    return lm.score_corpus(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_license_scan, op4_minhash, op5_warc, op6_mixing, op7_ann, op8_html_text, op9_exact_dedup, op10_lm, pipeline)}


_SPACE = r"[\x20\x09-\x0D]"


def _license_sql() -> str:
    """The scan line by line: what states a copyright is blanked, what only names a licence goes from the top, the rest is spelt alike."""
    from lexmill.llm.licenses import KNOWN, SPELLINGS

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    go_on = "notices?|holders?|owners?|licen[sc]es?|laws?|disclaimer|statements?|interest|and|or|in|is|as|are|of"
    states = rf"""(regexp_matches(l, '^[^a-z0-9]*(©|\(c\)[ \t]*(copyright|[0-9]{{4}}))')
        OR (regexp_matches(l, '^[^a-z0-9]*copyright[ \t]*[^ \t\n\f\r]') AND NOT regexp_matches(l, '^[^a-z0-9]*copyright[ \t]+({go_on})\b')))"""
    names = r"""regexp_matches(m[i], '^\s*$') OR regexp_matches(m[i], '^\s*(the[ \t]+)?[a-z0-9 \t.,''"/+-]{0,60}\blicense([ \t]*\([^()\n]{0,40}\))?(,?[ \t]*v(ersion)?[ \t.]*[0-9.]+)?[ \t.:]*$')"""

    def canonical(source: str, keep: str, text: str) -> str:
        """A query of ``keep`` and ``form`` over ``source``."""
        spelt = f"array_to_string(list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: CASE WHEN {states} THEN ' ' ELSE l END), chr(10))"
        for found, put in SPELLINGS:
            spelt = f"regexp_replace({spelt}, {quoted(found)}, {quoted(put)}, 'g')"
        rest = f"array_to_string(m[list_position(list_transform(range(1, len(m) + 1), lambda i: i = len(m) OR NOT ({names})), true):], chr(10))"
        return f"SELECT {keep}, trim(regexp_replace({rest}, '[^a-z0-9à-öø-ÿ]+', ' ', 'g')) AS form FROM (SELECT *, string_split({spelt}, chr(10)) AS m FROM {source})"

    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT min(license) AS license, form FROM ({canonical(f"(VALUES {known}) AS t(license, body)", "license", "body")}) GROUP BY form),
units AS (
    SELECT doc_id, true AS whole, text AS unit FROM documents
    UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents),
forms AS ({canonical("units", "doc_id, whole", "unit")}),
hits AS (SELECT doc_id, whole, license FROM forms JOIN known USING (form)),
found AS (SELECT doc_id, max(CASE WHEN whole THEN license END) AS text_license, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id)
SELECT DISTINCT d.doc_id, f.text_license, coalesce(f.notices, '') AS notices FROM documents d LEFT JOIN found f USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": _license_sql(),
        "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM q""",
        "op6_mixing": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS fills, 1.5 * sum(source_size) OVER () AS total FROM s),
l AS (
    SELECT *, (total - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level FROM c
    WINDOW r AS (ORDER BY fills, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT arg_min(level, fills) FROM l WHERE fills > level), cap))::DOUBLE AS target FROM l),
m AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m""",
        "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, sha256(bare) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    }

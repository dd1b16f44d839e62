"""The registered query of each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, lm_score, mixing, near_dedup, quality, secret_scan, token_files, toxicity, url_filter
from .common import table

#: the rules that the url query judges by
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda r: F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True)])
    rules = spark.range(1).select(F.inline(F.array(*map(rule, URL_RULES))))
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories toxic, as labelled, and toxic_spam: labelled toxic and of low quality."""
    spam = ((F.col("toxic") == 1) & (F.col("quality") == 0)).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", spam.alias("toxic_spam"))
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels, ("toxic", "toxic_spam"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"), vocabulary(token_files.VOCABULARY))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_minhash_near_dedup, op3_mix_sources, op4_secret_scan, op5_url_filter, op6_decontamination, op7_toxicity, op8_lm_score, op9_token_files, op10_importance_resampling)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, k AS keep_id, g AS group_size, doc_id IS NOT DISTINCT FROM k AS kept, text_sha256 FROM (
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS k,
                   count(*) OVER (PARTITION BY t) AS g, sha256(t) AS text_sha256 FROM d)""",
    "op2_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT n, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        x AS MATERIALIZED (SELECT n, len(s) AS c, unnest(s) AS g FROM s),
        p AS (SELECT a.n AS i, b.n AS j, any_value(a.c + b.c) AS c, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.n < b.n GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT i, j FROM p WHERE 100 * k >= 80 * (c - k)),
        e AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
        r(n, m) AS (SELECT n, n FROM s UNION SELECT r.n, e.j FROM r JOIN e ON r.m = e.i),
        c AS (SELECT r.n, min(t.doc_id) AS component_id FROM r JOIN s t ON r.m = t.n GROUP BY r.n)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (n)""",
    "op3_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
        c AS (SELECT *, (sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER r, 0)::BIGINT AS left_over,
                     (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER r, 0)::BIGINT AS shares
              FROM w WINDOW r AS (ORDER BY source_size::DECIMAL(30, 0) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, source_size::HUGEINT * 3 * shares <= weight::HUGEINT * left_over AS capped FROM c),
        g AS (SELECT min(left_over) FILTER (NOT capped AND shares = m) AS left_over, any_value(m) AS shares
              FROM (SELECT *, max(shares) FILTER (NOT capped) OVER () AS m FROM f)),
        t AS (SELECT f.source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (weight * g.left_over)::DOUBLE / g.shares::DOUBLE END AS target FROM f, g),
        q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)::BIGINT) END AS whole FROM t),
        x AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest, d.h,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
                     sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - tied <= rest AND 2 * (rest - (upto - tied)) >= tied)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""",
    "op5_url_filter": rf"""
        WITH r(rule, rh, rp, v) AS (VALUES {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM a),
        u AS (SELECT page_id, row_number() OVER () AS n, translate(host, {_AZ}) AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
        j AS (SELECT u.*, r.rule, r.v, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC) AS k
              FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1""",
}

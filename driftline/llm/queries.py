"""The registered queries opN_<name>, with production parameters over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, common, exact_dedup, hyperminhash, packing, pii, quality, token_counts, topk, url_filter

#: Rules of the url filter: longest wins.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
TOKEN_LIMIT = 4096
SEQUENCE_TOKENS, END_ID = 2048, 0
#: Labelled rows that are trained on at most.
MAX_LABELLED, LEAST_QUALITY = 2000, 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality label of its id: the tables have no labels of pages.

    Documents and pages of one id are mostly unrelated, so here hosts' posteriors stay near the overall rate and block
    next to nothing by themselves; where outcomes differ by host they decide pages.
    """
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES).withColumnRenamed("id", "page_id").withColumn("reputation", F.round("reputation", 6))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.train(quality.sample_texts(docs, table(spark, sf_dir, "labels"), MAX_LABELLED))
    out = quality.score(docs, network).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).withColumnRenamed("id", "doc_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)
    return out.withColumnRenamed("id", "doc_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into one index: the second meets the digests of the first and is appended."""
    path = common.scratch(spark)
    index = exact_dedup.DigestIndex(spark, "digests_" + path.rpartition("-")[2], path)
    out = exact_dedup.dedup_in_batches(index, exact_dedup.halves(table(spark, sf_dir, "documents")))
    spark.sql(f"DROP TABLE {index.name}")  # from the catalog; the files stay
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fits_chars")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.read_archives(spark, archives.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_reputation, op2_pii_spans, op3_quality_network, op4_near_dedup, op5_best_fit_packing, op6_exact_dedup, op7_exact_topk, op8_token_counts, op9_arc_to_warc, op10_byte_bpe)}

DOUBLE = ", ".join(f"'{x}'" for x in url_filter.DOUBLE_SUFFIXES)
RULES = " ".join(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}') THEN '{at}/{rest}'" for at, _, rest in (r.partition("/") for r, _ in sorted(URL_RULES, key=lambda r: -len(r[0]))))
BLOCKED = ", ".join(f"'{r}'" for r, verdict in URL_RULES if verdict == "block")


def level(name: str, own: str, parents: str, parent_of: str) -> str:
    """Posterior means and bounds of a level's groups: the prior's mean is the parent's, its strength fitted by moments."""
    return f"""
        {name}_g AS (SELECT {own}, sum(n) AS n, sum(k) AS k, any_value(p.mean) AS p FROM hosts JOIN {parents} p ON {parent_of} GROUP BY {own}),
        {name}_s AS (SELECT sum(p * (1 - p) * (n - 1)) AS room, CASE WHEN room > 0 THEN greatest(0, (sum(n * (k / n - p) ** 2) - sum(p * (1 - p))) / room) ELSE 0 END AS spread FROM {name}_g WHERE n > 0),
        {name}_f AS (SELECT {own}, s * p + k AS a, s * (1 - p) + n - k AS b FROM {name}_g, (SELECT coalesce(any_value(CASE WHEN spread > 0 THEN least(1000.0, greatest(1.0, 1 / spread - 1)) END), 1000.0) AS s FROM {name}_s)),
        {name} AS (SELECT {own}, a / (a + b) AS mean, least(1.0, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) AS upper FROM {name}_f)"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": rf"""
        WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        judged AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
        counted AS (SELECT host, count(*) AS n, sum(quality) AS k FROM judged JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
        split AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM judged),
        names AS (SELECT host, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS last FROM split),
        hosts AS (SELECT host, CASE WHEN two IN ({DOUBLE}) THEN three ELSE two END AS domain, CASE WHEN two IN ({DOUBLE}) THEN two ELSE last END AS suffix, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM names LEFT JOIN counted USING (host)),
        top AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mean FROM hosts),{level("suffixes", "suffix", "top", "true")},{level("domains", "domain", "suffixes", "p.suffix = hosts.suffix")},{level("sites", "host", "domains", "p.domain = hosts.domain")},
        ruled AS (SELECT *, CASE {RULES} END AS rule FROM judged)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ({BLOCKED}) OR (rule IS NULL AND upper < 0.5) THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS reputation FROM ruled JOIN sites USING (host)""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM q JOIN v c ON q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op9_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1), 1)), '') AS payload_digest,
            CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM g""",
}

"""The registered queries over the training-data tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import NOTICES, SPELLINGS, variants
from .licenses import COPYRIGHT_LINE, NO_WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lsh_forest import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import token_tables

    return token_tables(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived_pages

    return archived_pages(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "passages")


#: Production mix: clean text in four languages at four times and more the share of the low-quality domains.
MIX = {"en:1": 0.58, "de:1": 0.14, "fr:1": 0.14, "es:1": 0.10, "en:0": 0.02, "de:0": 0.008, "fr:0": 0.008, "es:0": 0.004}


def domain_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain (language and quality) of the labelled documents."""
    return documents.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").selectExpr("doc_id", "concat(lang, ':', quality) AS domain")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    documents = _table(spark, sf_dir, "documents")
    return mix(documents, domain_labels(documents, _table(spark, sf_dir, "labels")), MIX)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).withColumn("notice_ids", F.array_join("notice_ids", ","))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_forest": op1_forest,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_jaccard": op9_jaccard,
    "op10_token_tables": op10_token_tables,
}



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _respelt_sql(value: str, phrases: bool) -> str:
    for found, put in SPELLINGS:
        if (" " in found) == phrases:
            value = f"replace({value}, {_quoted(f' {found} '.replace(' ', '  ')[1:-1])}, {_quoted(f' {put} '.replace(' ', '  ')[1:-1])})"
    return value


def licenses_sql() -> str:
    """Digests of documents, known licences and notices, all by the same macros of SQL."""
    rows = lambda pairs: ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in pairs)
    bare = f"regexp_replace(lower(coalesce(text, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    spaced = f"' ' || replace(regexp_replace({bare}, {_quoted(NO_WORD)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    line = lambda c: f"sha256(trim(regexp_replace({_respelt_sql(c, True)}, ' +', ' ', 'g'), ' '))"
    flat = f"regexp_replace(c, '[ ' || chr(10) || ']+', '  ', 'g')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_respelt_sql(spaced, False)} AS c FROM documents),
        known AS (SELECT digest, min(id) AS license_id FROM (SELECT id, {line(flat)} AS digest
          FROM (SELECT id, {_respelt_sql(spaced, False)} AS c FROM (VALUES {rows(variants())}) t(id, text))) WHERE digest <> sha256('') GROUP BY digest),
        notices AS (SELECT digest, min(id) AS license_id FROM (SELECT id, {line(flat)} AS digest
          FROM (SELECT id, {_respelt_sql(spaced, False)} AS c FROM (VALUES {rows(NOTICES)}) t(id, text))) GROUP BY digest),
        l AS (SELECT n, {line('c')} AS digest FROM (SELECT n, unnest(string_split(c, chr(10))) AS c FROM d)),
        m AS (SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM l JOIN notices USING (digest) GROUP BY n),
        w AS (SELECT n, doc_id, {line(flat)} AS digest FROM d)
        SELECT doc_id, digest, license_id, coalesce(notice_ids, '') AS notice_ids FROM w LEFT JOIN known USING (digest) LEFT JOIN m USING (n)"""


ORACLE_SQL: dict[str, str] = {
    "op8_licenses": licenses_sql(),
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS x,
                     max(page_id) OVER (PARTITION BY html) AS largest FROM p)
        SELECT page_id, payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST((CAST('0x' || substr(x || '00', CAST(2 * (i * 5 // 8) + 1 AS BIGINT), 4) AS BIGINT)
                      // CAST(2 ** (11 - i * 5 % 8) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
          CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM h""",
}

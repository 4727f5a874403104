"""The registered queries of this folder, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, exact_dedup, langid, license_scan, minhash, mixing, packing, secret_scan, token_counts, toxicity
from .common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Weights of the mixture's tree: (domain,), (domain, lang) and (domain, lang, source); 1 where absent.
MIXTURE = {("0",): 2.0, ("1",): 1.0, ("2",): 1.0, ("3",): 1.0} | {(d, lang): w for d in "0123" for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(spark, table(spark, sf_dir, "documents"), shingle=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(True))
    profiles = langid.learn(spark, docs.where(~held_out))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True))
    net = toxicity.learn(spark, docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest_columns(secret_scan.scan(docs, secret_scan.learn(spark, docs)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"), weights=MIXTURE)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash, op2_license_scan, op3_exact_dedup, op4_language_id, op5_toxicity, op6_secret_scan, op7_mixing, op8_embedding_dedup, op9_token_counts, op10_packing)
}

ORACLES = {
    "op1_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
               least(d.doc_id, coalesce(low.b, d.doc_id)) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.doc_id = d.doc_id
    """,
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
               sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(many.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
               least(e.vec_id, coalesce(low.b, e.vec_id)) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id
    """,
}

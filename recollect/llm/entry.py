"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, decontam, dom_model, itq, kneser_ney, langid, rangecoder, simhash_nsw, substring


def op1_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kneser_ney.held_out_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.predict(docs).select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "n_spans")


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = cotrain.score(docs, labels).withColumnRenamed("id", "doc_id")
    keep = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return found.withColumns({"good": F.col("quality_score") >= 0.5, "toxic": F.col("toxic_score") >= 0.5, "kept": keep})


def op4_fixed_block_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring.remove_repeats(docs, map_out=substring.digest, out=substring.DIGEST).withColumnRenamed("id", "doc_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_model.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode(docs, tokenizer_path(), finish=bpe.digest, out=bpe.DIGEST).withColumnRenamed("id", "doc_id")


def op7_itq_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rangecoder.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
    return rangecoder.read(spark, files).withColumnRenamed("id", "doc_id")


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontam.overlaps(docs, benchmark).select(F.col("id").alias("doc_id"), "n_tokens", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"), "overlaps")
    return found


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_nsw.near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"), "n_shingles")


_WORDS = "d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)"
_OP4 = f"""WITH {_WORDS}, h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM h JOIN m USING (k) WHERE low < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d), y AS (SELECT x.doc_id, x.word, x.pos, g.pos IS NOT NULL AS gone FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos),
z AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON d.doc_id = z.doc_id"""
_REACH = "reach(node, root) AS (SELECT id, id FROM n UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.root = l.a)"
_OP7 = f"""WITH RECURSIVE n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS s FROM n WHERE len(e) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.95), {_REACH}
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.a = node) AS n_links, min(root) AS component_id, node = min(root) AS kept FROM reach GROUP BY node"""
_OP10 = f"""WITH RECURSIVE {_WORDS}, n AS (SELECT doc_id AS id FROM documents),
s AS (SELECT DISTINCT doc_id AS id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)), c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE common * 5 >= (ca.n + cb.n - common) * 4), {_REACH}
SELECT node AS doc_id, min(root) AS class_id, node = min(root) AS kept, coalesce(max(c.n), 0) AS n_shingles FROM reach LEFT JOIN c ON c.id = node GROUP BY node"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_fixed_block_substring_dedup": _OP4, "op7_itq_embedding_near_dedup": _OP7, "op10_simhash_near_dedup": _OP10}

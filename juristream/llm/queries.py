"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.llm import bpe, centroids, embeddings, infill, mixing, passages, simhash, tokenfiles, topk, toxicity, urls, warc, wordpiece
from juristream.llm.common import shared_path, table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, with_payload=False)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, keep=["doc_id"], with_passages=False)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc.doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc.doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], with_kept=False, with_text=True)
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), F.col("text").alias("kept_text"))


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), TOKENIZER, path, by_chunks=True)
    return tokenfiles.documents(spark, path, with_ids=False)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(table(spark, sf_dir, "documents"), with_output=False)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_token_counts, op3_warc, op4_simhash_near_dedup, op5_toxicity, op6_mixing, op7_suffix_array_dedup, op8_url_filters, op9_byte_bpe, op10_exact_top_k, op11_token_files, op12_centroid_clustering, op13_fill_in_middle)}
ORACLES: dict[str, str] = {"op6_mixing": mixing.SQL, "op10_exact_top_k": topk.SQL, "op12_centroid_clustering": centroids.SQL, "op13_fill_in_middle": infill.SQL}

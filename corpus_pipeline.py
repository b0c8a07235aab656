"""From raw documents to a tokenised mix: a chain of the operators in juristream.llm (see STAGES)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.llm import bpe, mixing, passages, simhash, toxicity
from juristream.llm.common import drop_path, scope, shared_path, table, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A passage of so many words goes, too, though it may have fewer bytes than op7's 400: the longest item of `benchmark` has 394.
WORDS = 50


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from these documents' labels holds for clean, null and empty texts among them (no evidence).

    Rows are judged one by one: null and repeated ids, repeated rows and very long texts are judged like others. Without labels of both
    kinds all stay. An empty table gives an empty one; columns of any names pass through."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, with_passages=False).where("predicted = 0").select("doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id's, nulls last; of equal ids the smallest text hash, of equal rows one.

    Null, empty and blank texts have one fingerprint, so one row of them stays. Very long texts count whole; an empty table gives an empty one;
    columns of any names pass through."""
    return simhash.one_of_each_group(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 400 bytes or of WORDS words that occur elsewhere too; n_chars follows the text. One may be left empty.

    A null text becomes an empty one. Null and repeated ids and equal rows are places of their own; texts of any length are looked at whole;
    an empty table gives an empty one; columns of any names pass through."""
    found = passages.remove_repeats(docs, words=WORDS, keep=[c for c in docs.columns if c != "text"], with_kept=False, with_text=True)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in whole as often as the mix takes it, in whole or in part.

    Null and empty texts have no words and are never taken. Null sources are one source; null and repeated ids and equal rows are rows of their
    own; an empty table gives an empty one; columns of any names pass through."""
    return mixing.taken_documents(mixing.mix(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256, round_trip of each document of the mix.

    A null text counts as empty; null and repeated ids are passed on; texts of any length are encoded whole; an empty table gives an empty one;
    other columns are left out."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]
#: Scans, suffix arrays and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage works on what its predecessor kept, as written to the shared folder and read again; that is deleted when the
    next stage is written, with the tables that a stage wrote for itself."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"pipeline-{k}-{name}")
        with scope():
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage works on all that the one before it kept.  The first four return the columns of ``documents``; the third
replaces the text (and ``n_chars``) of documents that lose words, the others only drop documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamframe.llm import decontaminate, near_copies, pieces, rule_lists, substring_dedup
from loamframe.llm.common import durable, stage_folders


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of theirs can meet one of an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("_others"))


def _unpacked(packed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **changed}
    return packed.select(*[(own[c] if c in own else F.col(f"_others.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and that no learned rule rejects."""
    counted = durable(rule_lists.with_statistics(docs, keep=["doc_id"]))
    rules = rule_lists.rules_from_labels(counted, _table(spark, sf_dir, "labels"))
    # worked out again rather than stored with every text
    return _unpacked(rule_lists.judge(rule_lists.with_statistics(_packed(docs)), rules).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8): that of the smallest id."""
    return _unpacked(near_copies.without_near_copies(_packed(docs)), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows; one that loses none keeps its text as it is."""
    cut, less = substring_dedup.remove_repeats(_packed(docs)), F.col("n_removed") > 0
    changed = {"text": F.when(less, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(less, F.length("kept_text")).otherwise(F.col("_others.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _unpacked(cut, docs, **changed)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside an occurrence of a benchmark window."""
    text = F.coalesce("text", F.lit(""))
    # equal texts share the verdict: 128 bits of hash stand for a text, so texts need not be stored beside it
    keyed = _packed(docs).withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit("second"), text)})
    marked = decontaminate.mark_overlaps(keyed, _table(spark, sf_dir, "benchmark"), keep=["_k1", "_k2"])
    hit = durable(marked.where("contaminated").select("_k1", "_k2").distinct())
    return _unpacked(keyed.join(hit, ["_k1", "_k2"], "left_anti"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with what they decode to."""
    return pieces.encode_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def _stage(function):
    """The function as a stage: what the stage before wrote for itself is deleted, as its result is written by now."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_folders(spark):
            return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("near-duplicates", _stage(near_duplicates)),
    ("substring dedup", _stage(repeated_passages)),
    ("decontamination", _stage(benchmark_passages)),
    ("sentencepiece", _stage(encoded)),
]

#: Learned rules, repeated windows and encodings have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs

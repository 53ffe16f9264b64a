"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go; of each group of near copies one document stays; later copies of long passages are cut; the rest is
put into training order by source weights; and the texts are encoded to token ids.

Cases, in every stage: an empty table stays empty; extra columns are kept up to the last stage, whatever their names. Null and empty texts
are not toxic (unless nearly all labelled texts without a telling word are), link with nothing, hold no passage, are of size 0 and so not
drawn by the mix. Rows without a doc_id are never near copies of others, come last where passages are cut, and are drawn and encoded like others.
Rows that repeat a doc_id are scored each by itself; of those that are linked one stays. Very long texts are taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelark.llm import bpe, toxicity
from tracelark.llm.common import discard, materialize, release, scope, table
from tracelark.llm.mixing import mix
from tracelark.llm.ngram_join import drop_near_copies
from tracelark.llm.suffix_dedup import cleaned

#: Bytes of a repeated passage that is cut: less than fifty short words.
PASSAGE = 200


#: Folders of the tables that the stages before have written on their way.
_LEFT: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before have left, as ``docs`` is their output, written and read again: tables in
    the shared folder and shuffles of whole texts."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_LEFT, spark=spark)
        _LEFT.clear()
        release(spark)
        with scope(_LEFT):
            return f(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from the labels, is below one half."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles."""
    return drop_near_copies(docs, k=5, num=80, den=100)


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of PASSAGE bytes or more; ``n_chars`` follows the text."""
    return cleaned(docs, PASSAGE)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's target asks for."""
    return mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and hashes of the token ids and of the text they decode to, one row per place in the order."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_copies),
    ("suffix_dedup", cut_passages),
    ("mixing", mixing),
    ("bpe", encode),
]

#: The stages' results depend on learnt models and on token merges, which SQL cannot express; tests hold the stages,
#: one after the other, against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents to packed training batches.

Each stage gets what its predecessor kept, written and read again, and calls
one operator of ``rootseek.llm``:

* language: documents without a letter, or of which no language holds a third, go;
* near_duplicates: one document of each group of similar ones stays;
* repeats: byte strings of 200 bytes that occur again are cut from the texts;
* packing: every token of what is left gets its place in a training batch.

A stage deletes the intermediate tables of the stage before in the same thread, which
are no longer needed once that stage's result is written. Those of the last stage
stay, since its result reads them when it is used.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootseek.llm import jaccard, language, packing, repeats
from rootseek.llm.common import durable, read
from rootseek.session import delete, written_here

#: Least share of a document's words for its first language.
LEAST_SHARE = 1 / 3
VOCABULARY = "word_bpe_49k.json"

_mine = threading.local()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame], last: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``work``, with the tables of the stage before deleted first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        behind = _mine.__dict__.setdefault("behind", [])
        delete(spark, behind)
        with written_here() as folders:
            out = work(spark, docs, sf_dir)
        if not last:
            behind.extend(folders)
        return out

    return run_stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.where(~language.held_out()))
    return language.accepted(docs, model, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", _stage(known_language)), ("near_duplicates", _stage(near_duplicates)), ("repeats", _stage(cut_repeats)), ("packing", _stage(pack, last=True))]

#: Language mixtures, byte strings and tokens have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

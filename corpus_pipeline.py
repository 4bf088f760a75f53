"""From raw documents to token ids: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the docs of the next one.

Defined results: a null text is scored, kept or dropped like an empty one and keeps its null until its tokens, which are
none; documents without words are duplicates of nothing; rows with a null id stay; of rows with one id and text one
stays, rows of one id with unlike texts are documents of their own; of a group of near copies the one with the
smallest id stays (of unlike texts of that id, the one with the smaller hash); an empty table gives no rows; a text of any
length is one row of work; other columns, whatever their names, are carried on to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm._util import materialize, table
from cairnspark.llm.bpe_automaton import encode, vocabulary_path
from cairnspark.llm.decontamination import decontaminate
from cairnspark.llm.ngram_jaccard import deduplicated
from cairnspark.llm.quality_classifier import accepted
from cairnspark.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text decoded from them."""
    return encode(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]
#: Models, components of a similarity graph and BPE merges have no SQL form; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.

1. quality rules: documents that break a rule go;
2. n-gram Jaccard join: of each group of near duplicates one document stays;
3. personal data: spans are replaced by their kinds;
4. mixing: documents are written in the order of their blocks' slots;
5. packing: one row per piece, with its sequence and place; groups and
   sequence ids follow the order in which mixing wrote the documents, by the
   part numbers of its files and the rows in each, whichever tasks read them.

Null ids and texts, repeated rows, empty tables and further columns are
treated as the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidscope.llm import mixing, ngram_join, packing, pii, quality
from bidscope.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn_contexts(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs)


def pack_in_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing and packing of documents that stand in any order."""
    return packing.pack_mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_in_order),
]

# Near duplicates, contexts and packing are beyond SQL: tests/llm compares
# every stage with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the packed pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: bad documents go, then exact copies, then near copies; what stays is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All stages but the last return the columns of documents; the last
returns the pieces of packed sequences. Near copies are texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, and chains of such.

Defined results, in every stage: a null text is an empty text; an empty table gives an empty result;
further columns stay as they are, whatever their names; rows are told apart by doc_id and text, so rows
with repeated or null ids do not share a fate unless their texts do too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import exact_dedup, pattern_packing, quality_cnn, simhash_bk
from foliomill.llm.common import written
from foliomill.shipping import ship

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows whose score is 0.5 or more stay; equal texts have equal scores. Without labels of both classes the more frequent one decides."""
    return quality_cnn.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of texts that are equal without white space the longest stays, then the least doc_id (null last); of rows that repeat both, one."""
    return exact_dedup.keep_one_of_equals(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near copies the row with the least doc_id (null last) stays, then the least digest; of rows that repeat both, one. Texts without words are one group."""
    ship(spark)
    return simhash_bk.keep_one_of_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of every row; rows that repeat a document are packed each, and an empty text is its end token."""
    ship(spark)
    return pattern_packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", packing),
]

#: A classifier, near-duplicate components and a packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

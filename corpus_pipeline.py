"""The corpus pipeline: from documents to packed training sequences, a table after each stage.

A null or empty text has no words, so the rules drop it, whatever the classifier says; a null doc_id is a document of its
own, and of rows with equal doc_ids all or none are drawn. Of equal texts the one with the smallest doc_id stays, a null one
last; of equal rows one. A class that the targets don't name, or null, is "other". Very long texts are read whole. Columns
beside those of documents pass through all stages but the last, whatever their names. Without labels every score is 0.5, so
the classifier keeps all. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import scratch, table, tokenizer_path, written
from lorekeep.llm.jaccard_join import one_of_each
from lorekeep.llm.mixing import mixed
from lorekeep.llm.packing import pack_documents
from lorekeep.llm.quality_model import accepted, fit
from lorekeep.llm.quality_rules import passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents that it is given. A null text counts as
    empty; repeated rows stay repeated."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects. Null and wordless texts have too few words; repeated rows stay repeated."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest doc_id; of equal rows one. Texts without
    words are no copies of each other. A null doc_id ranks last."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mixture; rows with equal doc_ids are drawn alike."""
    return mixed(docs).where(F.col("sampled")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents' token ids as pieces of training sequences; an empty text has its end id alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), slice_chars=2_000_000)


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]
#: SQL can't tokenize, fit or draw as these stages do; tests hold each against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; those before it, and what stages keep for themselves, are deleted at the end."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        return written(docs, "pipeline", keep=True)

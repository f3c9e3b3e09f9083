"""The corpus pipeline: stages of the operators in plancarta.llm, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in their
order, with the values that they have, text and n_chars of line dedup excepted. Further columns may have any names.

Defined cases, besides those of the operators: rows with a null id pass line dedup and near-dedup as they are, and mixing
and packing like others; rows that share an id are one document to line dedup, and all of them stay or go in near-dedup;
null or empty texts fail the quality rules, and where a stage gets them otherwise they stay as they are and pack as the
end id alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plancarta.llm.common import store, table
from plancarta.llm.lines import repeated_lines, without
from plancarta.llm.mixing import mixed_documents
from plancarta.llm.packing import pack
from plancarta.llm.quality import kept_documents
from plancarta.llm.simhash import one_of_each

#: Near-duplicates share shingles of so many words; their sets of these have that Jaccard similarity at least, or their
#: fingerprints differ in so many bits at most.
SHINGLE, RADIUS, SIMILARITY = 5, 3, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and short texts go."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; n_chars is that of the text that is left. A text may become
    empty; a null one stays null."""
    out = without(docs, repeated_lines(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; empty and null texts are copies of each other."""
    return one_of_each(docs, SHINGLE, RADIUS, SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, equal rows for more than once; texts without a word go."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in windows; each copy of a document is packed."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage{k}")
    return docs

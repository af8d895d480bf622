"""Documents to training pieces: quality rules, near-duplicates, benchmark, secrets, encoding.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
written as Parquet and read again.  All but the last return the columns of docs,
further ones included, whatever their names.  An empty table gives an empty one.
Rows that repeat an id are rows of their own but for the near-duplicate stage, where
those that repeat a text go with it.  Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import merge_dropout, quality_crf, secret_scan, shingle_similarity, suffix_decontam
from matchloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate lines go; so do null and empty texts."""
    return quality_crf.keep_good(docs, quality_crf.fit_field(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles, 0.8 alike or more, the document of the smallest id
    stays (ties: by text hash).  Null and empty texts are alike; rows without an id stay."""
    return shingle_similarity.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts have none."""
    return suffix_decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become marks, and n_chars follows; null stays null."""
    return secret_scan.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pieces) of every document that is left; a null text has null pieces."""
    return merge_dropout.encode(docs, keep=("lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("piece encoding", encoding),
]

#: SQL cannot express the trained line field, the XXH64 fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

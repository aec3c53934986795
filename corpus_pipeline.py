"""The corpus pipeline: quality classifier, quality rules, n-gram Jaccard join, secret scans, best-fit packing.

Every stage takes an empty table to an empty one, and columns besides those of ``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import table, written
from rollspark.llm.jaccard_join import first_rows
from rollspark.llm.packing import pack_documents
from rollspark.llm.quality_classifier import classify_quality
from rollspark.llm.quality_rules import quality_rules as judge
from rollspark.llm.secrets import redact, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null or empty text is judged as a text without words, null hosts and paths
    are sites of their own, a null key has no label; repeated rows are judged alike and all stay or all go."""
    return classify_quality(docs, table(spark, sf_dir, "labels"), columns=list(COLUMNS)).where("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null, empty or blank text has no words and goes; a null language is held against
    all; repeated rows are judged alike and all stay or all go."""
    return judge(docs, columns=list(COLUMNS)).where("kept").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row stays: the one with the smallest doc_id, null only where there is no other, then
    with the smallest hash of key and text. Texts without shingles link with nothing; each (doc_id, text) of them stays once."""
    rows = docs.select(*COLUMNS).withColumn("rid", F.xxhash64("doc_id", "text")).dropDuplicates(["rid"])
    return rows.join(first_rows(docs), "rid", "left_semi").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; ``n_chars`` follows the new text where there was one. All rows stay: null and empty
    texts as they are, repeated rows masked alike."""
    found = scan_secrets(docs.select(*COLUMNS))
    return redact(found).selectExpr("doc_id", "text", "lang", "source", "if(size(secrets) = 0, n_chars, cast(length(text) as bigint)) as n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences. A null or empty text is its end alone; repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: Classifier, shingle groups and tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as a table and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

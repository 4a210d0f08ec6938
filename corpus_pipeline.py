"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, packing, quality, secret_scan, simhash
from brindle.llm.common import spool, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of its input, scores below 0.3 go.

    Null texts are scored as empty ones. Rows that repeat fare alike. Where labels show one class or none, the score is a
    prior's, the share of good ones. Empty input gives no rows.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays; of rows that repeat it, one.

    Near copies have sets of five-word shingles of a similarity of 0.8 or more, or are linked by such. Null, empty and wordless
    texts are one group; a null id comes after all others. Empty input gives no rows.
    """
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in windows of benchmark items go.

    Null and wordless texts stay, as all do where the benchmark is empty. Rows that repeat fare alike. Empty input gives no rows.
    """
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; every document stays. Null texts stay null. Empty input gives no rows."""
    return secret_scan.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences: a row for each piece.

    Null and empty texts are a piece of the end mark alone. Rows that repeat an id are packed each. Empty input gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", sequence_packing),
]

#: No SQL states a trained network, tokenisation or a packing; tests hold the stages against brute force instead.
ORACLE_SQL = None

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order; what lies between them is written to the shared folder.

    Null ids, texts and other columns, empty and very long texts, ties, repeated rows and empty tables have the results that the
    stages state. Columns beyond those of documents are left behind.
    """
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in _COLUMNS))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = spool(docs, name)
    return docs

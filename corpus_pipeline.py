"""A corpus pipeline of five stages, each an operator of multisift.llm applied to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the session's shared folder and reads
it again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multisift.llm import langid, mixing, pii, similar, spm
from multisift.llm.common import ensure_checkpoint_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in one of the languages learned from these documents; texts without letters go."""
    return langid.only_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more; SimHash and minima of hashes propose."""
    return similar.keep_similar(docs, words=5, least=0.8, max_bits=6)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data in their texts replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in the order of the curriculum, repeats as rows of their own."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and ids of each document, with same_text: whether decoding gives the stage's input text back (null for a null text)."""
    model = spm.read_model()
    return spm.encode(docs, model, compared=True).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "same_text")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenise),
]

#: Learned languages, fingerprints and tokenisation can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

"""From raw documents to token ids: five training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: documents
of low quality go, one of each near-duplicate group stays, secrets are masked, sources are
sampled to target weights, and what is left is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import bpe, mixing, quality_model, secrets, simhash
from almanac.llm.common import documents, drop, labels, shared_dir
from almanac.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, the model fitted on the labelled ones among them.

    Null texts are scored as empty ones; repeated rows stay or go together; no rows give none.
    """
    return quality_model.keep_good(docs, labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, of Jaccard similarity 0.8 over shingles of five words.

    Null, empty and wordless texts are copies; of repeated rows one stays; documents without id
    stay where none of their group has one, one a group; rows of one id and unlike texts are
    documents of their own; no rows give none.
    """
    return simhash.keep_one(docs, width=5, budget=3, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Null texts stay null; repeated rows are masked alike; no rows give none.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities that bring sources, languages and topics to their targets.

    Null sources and languages are values of their own; documents without words stay; null ids
    are drawn by their text; repeated rows stay or go together; no rows give none.
    """
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document that is left; null and empty texts have no ids."""
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The classifier and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; between stages rows rest as Parquet in the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if i:  # what the stage before has written is read for the last time
                drop(spark, f"{base}/{i - 1}")
    return docs

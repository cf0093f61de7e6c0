"""The corpus pipeline: from raw documents to token ids of a cleaned, deduplicated, redacted and mixed corpus.

Each stage takes the documents that the one before kept and returns documents; the last returns one row of token
figures per document of the mix. Between stages the documents are written to the shared folder and read again.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, jaccard_join, mixing, pii, quality_rules
from siftwell.llm.shared import table
from siftwell.storage import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.kept(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return jaccard_join.representatives(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs)).withColumns({"n_chars": F.length("text").cast("long")}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words, on average over the documents of a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("personal data", redact),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the redaction by trees nor the encoding; a test follows the stages by brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs

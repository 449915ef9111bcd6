"""The pipeline over ``documents``: each stage applies one operator to all that the stage before kept.

Quality scores drop documents, near-duplicates keep one document of each group, personal data is redacted in place,
sources are mixed to target weights, and what is left is packed into sequences.

Defined cases, for all stages: a null text counts as empty; rows with null or repeated ids are rows of their own; an
empty table gives an empty table; other columns, whatever their names, go through every stage but the last, which
returns pieces. A stage's own cases are its operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm.common import materialize, table
from crawlframe.llm.minhash import keep_one
from crawlframe.llm.mixing import mix
from crawlframe.llm.packing import pack
from crawlframe.llm.pii import redact
from crawlframe.llm.queries import EPOCHS, REST, SEED, WEIGHTS
from crawlframe.llm.rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a score under 0.7 go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five words and a similarity of 0.8, the document with the smallest id stays."""
    return keep_one(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: spans are replaced by their kind; n_chars follows the new text."""
    return redact(docs, length="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents are repeated by their source's rate and dealt out anew."""
    return mix(docs, WEIGHTS, REST, EPOCHS, SEED, numbered=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of at most 2048 ids in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs

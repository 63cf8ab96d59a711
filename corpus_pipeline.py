"""From raw documents to packed training sequences, in five stages of the llm operators.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is the whole result of the stage before, and returns
its result; all but the last return the columns of ``documents``. ``run`` writes every result to the shared
folder and reads it back for the next stage, so a lost executor repeats one stage at most.

The order follows the cost of mistakes: junk goes first (it would only burden the join), one document of each
near-duplicate group stays, personal data is redacted in what is left, and only clean documents are repeated to the
target mixture and packed. ``ORACLE_SQL`` is None: the classifier is no SQL.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import jaccard, mixing, packing, pii, quality
from fleetlens.llm.registry import MIX_SEED, MIX_WEIGHTS
from fleetlens.llm.tables import documents, held_out, stored

#: Documents with a lower probability of quality 1 go.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels, train_fold=~held_out()))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of documents linked by five-word shingles at 0.8."""
    return jaccard.keep_first(docs, jaccard.join(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs

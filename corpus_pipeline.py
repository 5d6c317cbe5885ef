"""A training corpus from raw documents: five stages, each written and read again before the next.

Quality, near duplicates, benchmark decontamination, personal data, packing. A stage sees all rows that its predecessor
kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import latent, packing, pii, quality, sketches
from sheaf.llm.common import stored, table

#: Words of a shingle in the stage that drops near duplicates.
SHINGLE = 5


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sketches.representatives(docs, SHINGLE)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent.clean_of(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.cleaned(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(stored(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: Training, sketching and packing are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

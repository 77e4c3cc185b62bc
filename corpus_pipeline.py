"""From raw documents to packed training sequences: five stages, each on what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import decontamination, packing, personal, simhash, toxicity
from episodica.llm.tables import shared_folder, table
from episodica.sources.scratch import delete


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not found toxic; null and empty texts stay, equal rows stay or go together, all columns stay."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; null and empty texts are one group, equal rows are one row, all columns stay."""
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty texts stay, equal rows stay or go together, all columns stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind; n_chars follows the new text, null for null. All rows stay."""
    redacted = personal.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes; a null or empty text is one id, very long texts are many pieces."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("packing", pack_sequences),
]

#: The stages are trained models, graph components and packing, which SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each result is written to the shared folder and read again.

    Returns the last stage's rows, and in `texts` the folder of the rows, texts included, that it packed. The folders of
    the stages before are deleted once the next stage is written. Nulls, repeated rows and very long texts are what the
    stages say of them; of the documents' columns any may be null, and others may have any name but those. An empty table
    gives an empty result.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        written.append(f"{folder}/{name}")
        for gone in written[:-2]:
            delete(spark, gone)
    return docs.withColumn("texts", F.lit(written[-2]))

"""Documents to tokens: five stages, each one operator over all that the one before kept.

The first four return the columns of ``documents``: toxic documents go, one document of
each group of near duplicates stays (the least doc_id), documents with a verbatim
benchmark passage go, and personal data is replaced by its kind in brackets. The last one gives
the tokens of what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import common as c


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tabloom.llm.toxicity import drop_toxic

    return drop_toxic(docs, c.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tabloom.llm.near_dup import drop_near_duplicates

    # near copies are texts of a similarity of 0.8 or more; 0.65 lies six standard deviations of the estimate below
    return drop_near_duplicates(docs, percent=80, least=0.65)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tabloom.llm.decontaminate import remove_contaminated

    return remove_contaminated(docs, c.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tabloom.llm.pii import redact

    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabloom.llm.bpe import encode

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), columns=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]

#: The first stage is a trained model and the last a tokenizer; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, from checkpoint files; what the stages before it wrote is deleted once the next one has been written."""
    c.prepare(spark)
    docs = c.read(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i + 1 == len(STAGES):
                return c.held(docs)
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                c.deleted(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    finally:
        c.deleted(spark, folder)
    return docs

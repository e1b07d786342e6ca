"""Documents to training tokens in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm import exact_dedup, language_id, minhash_dedup, mixing, sentencepiece_codec
from agrolith.llm.shared import ROW, discard, documents, free_name, sized, small_batches, stored, with_rows

#: Tokens kept by the mixing stage, of all that reach it; each document is read once at most.
MIX_PERCENT = 80
#: Five-word Jaccard similarity, in percent, from which two documents are near copies; 85 is the contract of op7 alone.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tells each document's language from its text, which takes the place of the given ``lang``.

    Drops documents in which none can be told: null texts, texts without a letter, and all if
    no row has a lang and an id to learn from. Repeated rows and null ids stay, as do other columns.
    """
    small_batches(spark)
    found = docs.withColumn("lang", language_id.predicted(docs, language_id.fit(docs))["lang_pred"])
    return found.where(F.col("lang") != language_id.UNKNOWN)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, keeps one row: that with the largest doc_id, a null one last."""
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keeps one row: that with the smallest doc_id, a null one last. Texts without words stay."""
    small_batches(spark)
    return minhash_dedup.distinct_documents(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the budgets of their domain, language and source reach in one epoch; null lang and source are leaves of their own."""
    keyed = with_rows(docs)
    name = free_name(keyed, "chosen")
    chosen = stored(mixing.mix(keyed, percent=MIX_PERCENT, epochs=1, row=ROW).select(F.col(ROW).alias(name)), "pipeline-mix")
    return keyed.join(sized(chosen), keyed[ROW] == F.col(name), "left_semi").drop(ROW)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text, their crc32, and whether decoding them gives the text; the text itself goes. Null and empty texts have none."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs, ["doc_id", "lang", "source", "n_chars"], verify=True)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing to target weights", mix), ("SentencePiece", encode)]

#: Languages, near copies and piece ids are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i + 1}")
            discard(before)
    return docs

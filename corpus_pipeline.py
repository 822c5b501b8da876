"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Every stage takes any columns beside doc_id, text, lang, source and n_chars, also with names that operators use for
their results, and hands them on as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import mixing, packing, quality_neighbours, simhash, suffix_dedup
from tidegrid.llm.common import settle, table
from tidegrid.llm.queries import MAX_REPETITION, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is scored by its shape and may go; repeated rows go or stay together; whole texts are scored,
    however long; a tie with the threshold stays. Without labelled documents every score is 0 and all go.
    """
    model = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"))
    return quality_neighbours.score(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles have a similarity of 0.8 or more: the first by doc_id.

    Null and wordless texts are copies of each other; rows that are equal in every column count as one, other rows with
    the same id and text are ordered by a hash of the row; rows with a null doc_id all stay.
    """
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts; n_chars follows. Every document stays.

    A null text becomes empty; rows with the same doc_id don't take from each other; a null doc_id comes after all others.
    """
    left = F.col("kept_text")
    cut = suffix_dedup.remove_repeats(docs).withColumn("text", left)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length(left).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source is due; none goes.

    Null sources are one source; null and empty texts have no tokens and come with their block; rows with a null doc_id
    are dealt by their other columns.
    """
    return mixing.mix(docs, max_repetition=MAX_REPETITION).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null or empty text is its closing token alone; null and repeated ids stay rows of their own; long texts are cut,
    nothing is dropped.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus from raw documents: toxic ones go, near copies go, personal data is replaced, sources are mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm import bpe, mixing, nearcopies, pii, queries, toxicity
from planwise.llm.shared import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5."""
    grammar = queries.toxicity_grammar(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(docs, grammar) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; one without an id stays only where none of its group has one.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such pairs join.
    """
    return nearcopies.without_near_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text."""
    return pii.anonymize(docs, entities_as=None).withColumn("n_chars", F.char_length("text").cast("long"))


def in_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with mix_block, mix_slot and mix_offset; parts, and rows in them, follow the slots."""
    mixed = mixing.schedule(docs)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(parts, "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the mix's order: part files in name order, and rows in them, follow the slots."""
    return in_mix(spark, docs).drop("mix_block", "mix_slot", "mix_offset")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids and places in the mix, in its order. Reading files again loses their order, so places are computed anew: they follow from ids and sources."""
    path = queries.vocabulary_path()
    coded = in_mix(spark, docs).withColumn("ids", bpe.bpe_ids(path)(F.col("text")))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores, fingerprints, keyed surrogates and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

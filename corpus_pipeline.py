"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns packed
pieces. Between stages ``run`` writes Parquet to the shared folder, so that a lost executor never repeats a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import benchmark_suffixes, crf_language, packing, sanitise, superminhash
from attestra.llm.common import checked_broadcast, saved, table
from attestra.llm.tokens import public_file

#: Mean posterior a document's language must reach; texts in one of the learned languages come close to 1.
LEAST_POSTERIOR = 0.4
#: Near-duplicate similarity in per cent.
SIMILARITY = 80


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without those whose id is in ``gone``; ids go to the tasks if they are few, else both sides are shuffled."""
    return docs.join(checked_broadcast(saved(gone.select("doc_id").where("doc_id is not null").distinct(), name)), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts and texts without a letter among them, row by row."""
    return crf_language.keep_identified(docs, LEAST_POSTERIOR)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays.

    Rows that share a doc_id are one document and stay or go together; rows without an id are in no group and stay, as do
    null, empty and wordless texts.
    """
    return _without(docs, superminhash.near_duplicates(docs, percent=SIMILARITY).where(~F.col("kept")), "near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go.

    Rows that share a doc_id go if one of them is contaminated. Rows without an id cannot be told apart by it and stay;
    null, empty and wordless texts are clean.
    """
    return _without(docs, benchmark_suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "contaminated")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text.

    All rows stay, repeated ones each; rows without an id lose their base spans, terms only rows with one. Null stays null.
    """
    return sanitise.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences.

    Every row is packed, repeated ones and those without an id each by itself; a null or empty text is its end id alone.
    """
    return packing.pack(docs, public_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("pack", pack)]
#: A random field, signatures and subword ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: language, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the token ids. run() stores every stage as Parquet.

Defined results of every stage: an empty table stays empty; other columns may have any name and come
through unchanged, the last stage drops them; a null id is an id like any other, and rows that share
one are separate documents unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exact_dedup, language, pieces, simhash
from ledgerloom.llm.common import documents, held_out
from ledgerloom.llm.queries import PIECE_MODEL
from ledgerloom.plans.shared import Stored


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language has at least half of them; null and empty texts and those without letters go.

    Rows repeated in full get the same decision. Nothing learned (no labelled row): all go.
    """
    model = language.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return language.keep_identified(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id; null equals empty.

    Of rows repeated in full one stays; a null id loses against any other.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest id that is not null, then the smallest text hash.

    Texts without words are one group; rows repeated in full are one document and all stay.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null, empty and wordless texts stay, as all do with an empty benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chars, round_trip and ids of every row, repeated ones too; null is an empty text."""
    return pieces.round_trips(docs, PIECE_MODEL, with_ids=True)


STAGES = [
    ("language", identified_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("token ids", token_ids),
]

#: Fingerprints, mixtures and piece scores have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        stored = Stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            before.drop()
        docs, before = stored.frame, stored
    return docs

"""A training corpus from `documents`: languages, near copies, benchmark text, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs. All but the last return the
columns of docs; the last returns the packed pieces. Extra columns of docs, whatever their names, are carried along up to the last stage.

Null, empty or wordless texts: rejected by the first stage (no language); given to a later stage, they are kept as they are, but for one of each group
of equal ones. Null doc_id: a document like others; of a group of near copies one with an id stays, if there is any, the smallest.
Repeated ids and rows: told apart by their place; equal texts are near copies of each other. Null lang or source: kept, a null lang gets the predicted one.
Very long texts: whole. Empty tables: every stage gives an empty table.

Intermediate tables of a stage are deleted when the next stage begins, since its docs have been written by then (those that docs reads are spared).
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.llm import decontamination, langid, packing, pii, simhash
from lamellar.llm.common import drop_paths, staged, written, written_since

#: Documents of a lower language score than this are rejected, like those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


#: What the last stage has written.
_SPENT: list[str] = []


def stage(f):
    """f as a stage: it deletes the intermediate tables of the stage before (the first stage leaves those of another run)."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ != STAGES[0][0]:
            drop_paths(spark, _SPENT, docs)
        mark = written()
        out = f(spark, docs, sf_dir)
        _SPENT[:] = written_since(mark)
        return out

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is told with LEAST_LANGUAGE_SCORE; a null lang gets the predicted one."""
    told = langid.identify(docs, langid.train(docs), ("__lamellar_lang", "__lamellar_score"))
    told = told.where((F.col("__lamellar_lang") != "und") & (F.col("__lamellar_score") >= LEAST_LANGUAGE_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "__lamellar_lang")).select(*docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.one_of_each(docs)


@stage
def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without benchmark passages."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, personal data replaced; n_chars follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_text", benchmark_text), ("personal_data", personal_data), ("packed", packed)]

#: No stage but the last could be told in SQL, and that not either: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

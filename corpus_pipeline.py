"""A corpus pipeline of the operators in ``stockloom.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one
before has kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import decontam, jaccard, langid, mixing, tokenstore
from stockloom.llm.queries import read
from stockloom.llm.store import drop, materialize, scratch, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects.

    The model learns from the labels of this stage's own input. Documents go
    that it takes for none of its languages, that it surely takes for another
    language than their label says, or that have no letter.
    """
    ship(spark)
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every class of near duplicates, the one of least id."""
    ship(spark)
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship(spark)
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their target weights; a document stands as often as the mix takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids to a content-addressed store and return what its files say of each document."""
    ship(spark)
    path = tokenstore.default_path(spark)
    tokenstore.write(docs, path, tokenstore.default_tokenizer())
    return tokenstore.read(spark, path)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_output),
]

#: SQL can express neither the learned nor the edit-distance stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has written for itself goes when it is done."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name), keep=True)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

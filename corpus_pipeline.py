"""A cleaning pipeline over ``documents``: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, secrets are blotted out, and what is left is encoded. ``STAGES`` lists the steps; each reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.bpe import bpe_encode_decode
from quillmere.llm.decontaminate import decontaminate
from quillmere.llm.ngram_join import keep_one_of_each
from quillmere.llm.secrets import redact
from quillmere.llm.shared import materialize, read_table
from quillmere.llm.toxicity import learn_from_tables, toxicity_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trained = learn_from_tables(spark, docs, sf_dir)
    names = {c: f"own_{c}" for c in docs.columns}  # so that no column clashes with the score
    own = docs.select(*(docs[c].alias(n) for c, n in names.items()), "text")
    scored = toxicity_score(own, trained, keep=tuple(names.values())).where("predicted = 0")
    return scored.select(*(scored[n].alias(c) for c, n in names.items()))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("secrets", blot_secrets),
    ("bpe", encode),
]

#: The stages learn, hash and walk; SQL cannot express them. tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""A training corpus made from raw documents: five operators in a row, each on all that the one before it kept.

The stages read a document's text whole. Documents that a stage drops are gone for the next; personal data is masked in place;
the last stage gives the token ids. Each stage but the last returns the columns that it got, extra ones too.

Rows with a null doc_id can't be told apart: near-duplicate removal and decontamination keep them, language identification
and masking treat them as any other. Null and empty texts have no language and are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import decontaminate, langid, minhash, pii, piece_viterbi
from reelspark.llm.common import small_batches, written


def _mapped(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """docs with each Arrow batch changed, columns and types as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: neither undetermined nor ambiguous."""
    model = spark.sparkContext.broadcast(langid.fit(docs))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model.value
        return batch.filter(pa.array([not own.predict(t)[2] for t in batch.column("text").to_pylist()], type=pa.bool_()))

    return _mapped(docs, keep)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text masked by kind, n_chars as the new text has it."""
    schema = docs.schema

    def mask(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        old = batch.column(at).to_pylist()
        new = [pii.masked(t) for t in old]
        columns = [*batch.columns]
        columns[at] = pa.array(new, type=batch.schema.field(at).type)
        n = batch.schema.get_field_index("n_chars")
        if n >= 0:
            kept = columns[n].to_pylist()
            columns[n] = pa.array([k if o == t else len(t) for k, o, t in zip(kept, old, new, strict=True)], type=batch.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _mapped(docs, mask)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document: the corpus as token ids, each checked by decoding."""
    own = piece_viterbi.encode_documents(docs)
    return own.selectExpr("doc_id", "ids", "cast(coalesce(size(ids), 0) as bigint) as n_tokens", "coalesce(exact, true) as round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", pieces),
]
#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs

"""From raw documents to packed sequences, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of ``documents``; the last one returns packed pieces. Ids tell documents apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import common, exact_dedup, language_id, near_text, queries, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike any language's own documents, go.

    A missing ``lang`` is filled in with the prediction.
    """
    common.bound_batches(spark)
    # As one column, the row can't clash with what the operator adds.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = language_id.identify(rows, queries.language_model(docs), keep=("row",)).filter(~F.col("rejected"))
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id stays, repeated rows once."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8 or more stays, that with the smallest id.

    Candidates are texts whose SimHash fingerprints meet in balls and, for similarities that lie beyond these, min-wise keys.
    Of rows that share this id all stay, and so do rows without an id, which can't be told apart.
    """
    common.bound_batches(spark)
    found = near_text.near_duplicates(docs)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("gone")).distinct()
    gone = common.broadcast_if_small(common.materialize(gone, "near-gone"))
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    length = F.char_length("text").cast("long").alias("n_chars")
    found = secrets.redact(docs)
    return found.select(*(length if c == "n_chars" else c for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, in sequences of at most 2048."""
    common.bound_batches(spark)
    return queries.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Kneser-Ney models, SimHash, min-wise hashing and BPE aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

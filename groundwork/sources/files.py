"""Scans and sinks: JSON lines, inline passages, file hashes, versioned documents, JSON results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundwork import schemas


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples of a JSON-lines file. A malformed row, or one without a required field, ends the job."""
    rows = spark.read.schema(schemas.EVAL_EXAMPLE).option("mode", "FAILFAST").json(path)
    required = ("question_id", "doc_id", "question", "passages")
    checked = rows.select(
        *[F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is missing")).cast(rows.schema[c].dataType)).alias(c) for c in required],
        F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
        F.coalesce("requires_abstention", F.lit(False)).alias("requires_abstention"),
    )
    return checked


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Missing values of a record kind replaced by its defaults."""
    return df.fillna({k: v for k, v in schemas.DEFAULTS[kind].items() if k in df.columns})


def inline_chunks(df: DataFrame, id_col: str, doc_col: str, passages_col: str) -> DataFrame:
    """(scope, doc_id, chunk_id, text) of passages that come with a question; without a document they are ``inline``."""
    doc = F.coalesce(F.col(doc_col).cast("string"), F.lit("inline"))
    return df.select(F.col(id_col).alias("scope"), doc.alias("doc_id"), F.posexplode(passages_col).alias("_k", "text")).select(
        "scope", "doc_id", F.concat_ws(":", F.col("doc_id"), F.lit("passage"), F.col("_k").cast("string")).alias("chunk_id"), "text"
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def upload(known: DataFrame, new: DataFrame) -> DataFrame:
    """(sha256, doc_id, is_new) of uploads: equal bytes are one document, and known ones keep their id."""
    first = new.groupBy("sha256").agg(F.min("doc_id").alias("_new"))
    old = known.groupBy(F.col("sha256").alias("_sha")).agg(F.min("doc_id").alias("_old"))
    return first.join(old, F.col("sha256") == F.col("_sha"), "left").select(
        "sha256", F.coalesce("_old", "_new").alias("doc_id"), F.col("_old").isNull().alias("is_new")
    )


def reingest(documents: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``documents`` with one more version of each named document; ``version`` counts from 1, old ones stay."""
    latest = latest_versions(documents)
    again = latest.join(doc_ids.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    return documents.unionByName(again.withColumn("version", F.col("version") + 1))


def latest_versions(documents: DataFrame) -> DataFrame:
    by_age = Window.partitionBy("doc_id").orderBy(F.col("version").desc())
    return documents.withColumn("_rk", F.row_number().over(by_age)).where("_rk = 1").drop("_rk")


def status(documents: DataFrame, doc_id) -> DataFrame:
    """Statuses and flags of a document's latest version."""
    return latest_versions(documents.where(F.col("doc_id") == doc_id))


def write_result(summary: dict, path: str) -> dict:
    """A summary as sorted, indented JSON; parent folders are made."""
    from pathlib import Path

    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(summary, indent=2, sort_keys=True) + "\n")
    return summary

"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written and read again as the next one's
docs. All but the last return the columns of ``documents``, with ``n_chars`` kept true to the text.

Defined cases are those of the operators: a null text is packed as an empty one, a null id passes the
stages that need an id, repeated rows are one document, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import lines, packing, simhash, suffix, toxicity
from groundwork.llm.common import cut, discard, table

#: Chunks that a worker remembers in packing: fewer than packing's own, as executors are at their fullest here.
PACK_CACHE = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stand in an earlier place."""
    return _counted(lines.line_dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    SimHash fingerprints of five-word shingles give candidates; texts link at an exact Jaccard similarity of 0.8 or more.
    """
    return simhash.near_dedup(docs).select(*COLUMNS)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that occur elsewhere."""
    return _counted(suffix.dedup_texts(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their place in sequences."""
    return packing.pack(docs, cache=PACK_CACHE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("suffix_dedup", dedup_substrings),
    ("packing", pack_tokens),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # written by the stage before
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)

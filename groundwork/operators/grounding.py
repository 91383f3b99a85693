"""Verification of answer sentences against the chunks that they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T

MIN_OVERLAP = 0.35


def verify(sentences: DataFrame, retrieved: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Sentences with ids deduplicated, verdict, reason and support_score.

    sentences (answer_id, pos, text, ids), any other columns kept; retrieved (answer_id, rk, chunk_id,
    text), of which the last text of a repeated chunk_id counts. An answer's retrieved chunks are a
    top-k list, so they travel as one array and both sides meet once, by answer.

    The first that applies is the reason: empty_sentence, missing_supporting_chunk_ids,
    supporting_chunk_not_retrieved, numeric_claim_not_in_evidence, insufficient_evidence_overlap.
    """
    if not 0 < min_overlap <= 1:
        raise ValueError("min_overlap must lie in (0, 1]")
    evidence = retrieved.groupBy(F.col("answer_id").alias("_a")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("rk", "chunk_id", T.tokens(F.col("text"), T.EVIDENCE_STOP).alias("tok"), T.numbers(F.col("text")).alias("num"))
            )
        ).alias("_ev")
    )
    own = F.col("text")
    rows = (
        sentences.withColumn("ids", F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))))
        .join(evidence, F.col("answer_id") == F.col("_a"), "left")
        .drop("_a")
        .withColumn("_ev", F.coalesce("_ev", F.array().cast("array<struct<rk:int,chunk_id:string,tok:array<string>,num:array<string>>>")))
        # a space joins the cited texts and no pattern crosses one, so their sets unite
        .withColumn("_cited", F.transform("ids", lambda i: F.try_element_at(F.filter("_ev", lambda e: e["chunk_id"] == i), F.lit(-1))))
        .withColumn("_tok", F.flatten(F.transform(F.filter("_cited", lambda e: e.isNotNull()), lambda e: e["tok"])))
        .withColumn("_num", F.flatten(F.transform(F.filter("_cited", lambda e: e.isNotNull()), lambda e: e["num"])))
        .withColumn("_share", T.share(T.tokens(own, T.EVIDENCE_STOP), F.col("_tok")))
        .withColumn(
            "reason",
            F.when(F.coalesce(T.strip(own), F.lit("")) == "", "empty_sentence")
            .when(F.size("ids") == 0, "missing_supporting_chunk_ids")
            .when(F.exists("_cited", lambda e: e.isNull()), "supporting_chunk_not_retrieved")
            .when(F.size(F.array_except(T.numbers(own), F.col("_num"))) > 0, "numeric_claim_not_in_evidence")
            .when(F.col("_share") < min_overlap, "insufficient_evidence_overlap"),
        )
    )
    checked = F.col("reason").isNull() | F.col("reason").isin("numeric_claim_not_in_evidence", "insufficient_evidence_overlap")
    return (
        rows.withColumn("verdict", F.when(F.col("reason").isNull(), "supported").otherwise("unsupported"))
        .withColumn("support_score", F.when(checked, F.round("_share", 9)).otherwise(0.0))
        .drop("_ev", "_cited", "_tok", "_num", "_share")
    )


def decide(answers: DataFrame, verified: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(answer_id, n_sentences, unsupported_sentence_count, abstained, abstain_reason, retrieved_chunk_ids).

    Every one of ``answers`` (answer_id) has a row. No sentence, or an unsupported one, abstains.
    """
    counts = verified.groupBy(F.col("answer_id").alias("_a")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "unsupported").alias("bad")
    )
    out = answers.select("answer_id").join(counts, F.col("answer_id") == F.col("_a"), "left")
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    columns = [
        "answer_id",
        n.alias("n_sentences"),
        bad.alias("unsupported_sentence_count"),
        ((n == 0) | (bad > 0)).alias("abstained"),
        F.when(n == 0, "no_answer_sentences").when(bad > 0, "grounding_contract_failed").alias("abstain_reason"),
    ]
    if retrieved is None:
        return out.select(*columns)
    ids = retrieved.groupBy(F.col("answer_id").alias("_r")).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rk", "chunk_id"))), lambda x: x["chunk_id"])).alias("_ids")
    )
    return out.join(ids, F.col("answer_id") == F.col("_r"), "left").select(
        *columns, F.coalesce("_ids", F.array().cast("array<string>")).alias("retrieved_chunk_ids")
    )

"""Evaluation of answers against expectations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators.qa import ask_inline


def rows(examples: DataFrame, top_k: int = 5) -> DataFrame:
    """A row for each example with its answer and what is right about it; an index an example."""
    got = ask_inline(examples, "question_id", "question", "passages", "doc_id", top_k).withColumnRenamed("qid", "_q")
    return examples.join(got, F.col("question_id") == F.col("_q")).select(
        "question_id",
        "requires_abstention",
        "expected_answer",
        "answer",
        "abstained",
        "abstain_reason",
        "retrieved_chunk_ids",
        F.when(F.col("abstained"), 0).otherwise(1).cast("long").alias("n_sentences"),
        F.when(F.col("abstained"), 0).otherwise(1).cast("long").alias("n_supported"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row of counts and rates of :func:`rows`. Rates are rounded to 4 digits and 0 where nothing counts."""
    expected, predicted = F.col("requires_abstention"), F.col("abstained")
    n = results.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(~expected).alias("answerable_questions"),
        F.count_if(expected).alias("abstention_expected"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(predicted & expected).alias("right"),
        F.count_if(~expected & (F.col("answer") == F.col("expected_answer"))).alias("exact"),
        F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("n_supported"), F.lit(0)).alias("supported"),
    )
    c = F.col
    return n.select(
        "n_questions",
        "answerable_questions",
        "abstention_expected",
        (c("n_questions") - c("predicted")).alias("answered_questions"),
        T.safe_div(c("predicted"), c("n_questions")).alias("abstention_rate"),
        T.safe_div(c("exact"), c("answerable_questions")).alias("exact_answer_match"),
        T.safe_div(c("right"), c("predicted")).alias("abstention_precision"),
        T.safe_div(c("right"), c("abstention_expected")).alias("abstention_recall"),
        T.safe_div(c("supported"), c("total")).alias("citation_coverage"),
        T.safe_div(c("total") - c("supported"), c("total")).alias("unsupported_claim_rate"),
    )


def claim_rates(decided: DataFrame) -> DataFrame:
    """One row: answers, abstained, sentences, supported, coverage and unsupported rate of :func:`grounding.decide`.

    Sentences of an abstained answer count as well, so a rejected claim shows in the rates.
    """
    total, bad = F.coalesce(F.sum("n_sentences"), F.lit(0)), F.coalesce(F.sum("unsupported_sentence_count"), F.lit(0))
    return decided.agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if("abstained").alias("n_abstained"),
        total.alias("total_sentences"),
        (total - bad).alias("supported_sentences"),
        T.safe_div(total - bad, total).alias("citation_coverage"),
        T.safe_div(bad, total).alias("unsupported_claim_rate"),
    )


def evaluate(examples: DataFrame, top_k: int = 5) -> dict:
    """The summary as a dictionary, with a row an example and the time of the job spread over them."""
    found = rows(examples, top_k).persist()
    try:
        began = time.perf_counter()
        out = summary(found).first().asDict()
        took = (time.perf_counter() - began) * 1000
        done = [r.asDict() for r in found.orderBy("question_id").collect()]  # the report that was asked for
    finally:
        found.unpersist()
    each = round(took / max(1, len(done)), 3)
    return out | {"latency_ms_per_question": each, "median_latency_ms": each if done else 0.0, "rows": [r | {"latency_ms": each} for r in done]}


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(qid, precision, recall, ndcg, mrr) at k; hits (qid, rk, item), relevant (qid, item), gains of one."""
    good = relevant.select(F.col("qid").alias("_q"), F.col("item").alias("_i")).distinct()
    n = good.groupBy(F.col("_q").alias("_n")).agg(F.count(F.lit(1)).alias("n"))
    found = (
        hits.where(F.col("rk") <= k)
        .join(good, (F.col("qid") == F.col("_q")) & (F.col("item") == F.col("_i")))
        .groupBy(F.col("qid").alias("_h"))
        .agg(F.count(F.lit(1)).alias("c"), F.sum(1 / F.log2(F.col("rk") + 1)).alias("dcg"), F.min("rk").alias("first"))
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    c = F.coalesce("c", F.lit(0))
    return n.join(found, F.col("_n") == F.col("_h"), "left").select(
        F.col("_n").alias("qid"),
        F.round(c / k, 6).alias("precision"),
        F.round(c / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def latency(df: DataFrame, col: str, digits: int = 3) -> DataFrame:
    """(p50, p95, p99, mean) of a column, exact percentiles; no value gives 0."""
    of = lambda p: F.round(F.coalesce(F.percentile(col, F.lit(p)), F.lit(0.0)), digits)
    return df.agg(of(0.5).alias("p50"), of(0.95).alias("p95"), of(0.99).alias("p99"), F.round(F.coalesce(F.avg(col), F.lit(0.0)), digits).alias("mean"))


def gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed) of a one-row frame; a metric passes from its threshold on."""
    names = ", ".join(f"'{m}', cast({m} as double), cast({t!r} as double)" for m, t in thresholds.items())
    return metrics.selectExpr(f"stack({len(thresholds)}, {names}) as (metric, value, threshold)").withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    )

"""Question answering: search, choose one sentence, verify it, answer or abstain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import grounding, index, scan
from groundwork.sources.files import inline_chunks


def candidates(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, sentence, chunk_id, confidence): each query's best sentence of the chunks found.

    A sentence is worth the share of the question's tokens in it, times its chunk's score; equal ones
    go to the greater chunk_id, then the better rank, then the earlier sentence. hits: (qid, rk,
    chunk_id, score, text).
    """
    q = queries.select(F.col("qid").alias("_q"), T.tokens(F.col("question")).alias("_qt"))
    rows = hits.join(q, F.col("qid") == F.col("_q")).select(
        "qid", "rk", "chunk_id", "score", "_qt", F.posexplode(T.sentences(F.col("text"))).alias("k", "sentence")
    )
    worth = F.round(T.share(F.col("_qt"), T.tokens(F.col("sentence"))) * F.col("score"), index.DIGITS)
    key = F.struct("confidence", "chunk_id", -F.col("rk"), -F.col("k"))
    return (
        rows.withColumn("confidence", worth)
        .where("confidence > 0")
        .groupBy("qid")
        .agg(F.max_by(F.struct("sentence", "chunk_id", "confidence"), key).alias("c"))
        .select("qid", "c.*")
    )


def ask(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int = 5,
    min_overlap: float = grounding.MIN_OVERLAP,
    scope: Column | None = None,
    doc_ids: DataFrame | None = None,
) -> DataFrame:
    """A row for each of ``queries`` (scope, qid, question).

    qid, answer, abstained, abstain_reason, supporting_chunk_id, confidence, support_score,
    retrieved_chunk_ids, best_supporting_passages; the answer is empty where it abstains.
    """
    found = index.search(queries, chunks, top_k, scope, doc_ids)
    own = F.lit(0).cast("long") if scope is None else scope
    texts = chunks.select(own.alias("_s"), F.col("chunk_id").alias("_c"), "text")
    place = queries.select(F.col("qid").alias("_pq"), F.col("scope").alias("_ps"))
    hits = (
        found.join(place, F.col("qid") == F.col("_pq"))
        .join(texts, (F.col("_ps") == F.col("_s")) & (F.col("chunk_id") == F.col("_c")))
        .select("qid", "rk", "chunk_id", "score", "text")
    )
    best = candidates(queries, hits)
    retrieved = hits.withColumnRenamed("qid", "answer_id")
    said = best.select(
        F.col("qid").alias("answer_id"), F.lit(0).alias("pos"), F.col("sentence").alias("text"), F.array("chunk_id").alias("ids"), "confidence"
    )
    verified = grounding.verify(said, retrieved, min_overlap).select(
        F.col("answer_id").alias("_v"), F.col("text").alias("_text"), "ids", "confidence", "verdict", "support_score"
    )
    lists = hits.groupBy(F.col("qid").alias("_l")).agg(F.array_sort(F.collect_list(F.struct("rk", "chunk_id", "text"))).alias("_hits"))
    none = F.array().cast("array<string>")
    ok = F.coalesce(F.col("verdict") == "supported", F.lit(False))
    return (
        queries.select("qid")
        .join(lists, F.col("qid") == F.col("_l"), "left")
        .join(verified, F.col("qid") == F.col("_v"), "left")
        .select(
            "qid",
            F.when(ok, F.col("_text")).otherwise("").alias("answer"),
            (~ok).alias("abstained"),
            F.when(F.col("_hits").isNull(), "no_retrieved_evidence")
            .when(F.col("verdict").isNull(), "no_candidate_sentence")
            .when(~ok, "grounding_contract_failed")
            .alias("abstain_reason"),
            F.when(ok, F.get("ids", F.lit(0))).alias("supporting_chunk_id"),
            F.when(ok, F.col("confidence")).alias("confidence"),
            F.when(ok, F.col("support_score")).alias("support_score"),
            F.coalesce(F.transform("_hits", lambda h: h["chunk_id"]), none).alias("retrieved_chunk_ids"),
            F.coalesce(F.transform("_hits", lambda h: h["text"]), none).alias("best_supporting_passages"),
        )
    )


def ask_inline(questions: DataFrame, id_col: str, question_col: str, passages_col: str, doc_col: str | None = None, top_k: int = 10) -> DataFrame:
    """Answers of questions that bring their passages; each has an index of its own. Ids only label passages."""
    rows = questions.withColumn("_doc", F.lit("inline") if doc_col is None else F.col(doc_col))
    chunks = inline_chunks(rows, id_col, "_doc", passages_col)
    queries = rows.select(F.col(id_col).alias("scope"), F.col(id_col).alias("qid"), F.col(question_col).alias("question"))
    return ask(queries, chunks, top_k, scope=F.col("scope"))


def trace(queries: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """(qid, terms, matched_chunks, retrieved_chunks): how many rows each stage of a search keeps."""
    a = scan.asked(queries)
    if a is not None:
        m, chunk_count = scan.matched(a, chunks)
        t = np.bincount(a.query, a.times, len(a.qids)).astype(int).tolist()
        rows = list(zip(a.qids, m, t, strict=True)) if chunk_count else []
        both = queries.sparkSession.createDataFrame(rows, f"_m {a.kind}, m long, t long")
        matched, n = both.select("_m", "m"), both.select(F.col("_m").alias("_t"), "t")
    else:
        post = index.asked(index.postings(chunks), index.asked_terms(queries))
        terms = index.query_terms(queries, post, index.chunk_counts(chunks))
        matched = index.rank(terms, post, 2**31 - 1).groupBy(F.col("qid").alias("_m")).agg(F.count(F.lit(1)).alias("m"))
        n = terms.groupBy(F.col("qid").alias("_t")).agg(F.count(F.lit(1)).alias("t"))
    return (
        queries.select("qid")
        .join(n, F.col("qid") == F.col("_t"), "left")
        .join(matched, F.col("qid") == F.col("_m"), "left")
        .select(
            "qid",
            F.coalesce("t", F.lit(0)).alias("terms"),
            F.coalesce("m", F.lit(0)).alias("matched_chunks"),
            F.least(F.coalesce("m", F.lit(0)), F.lit(top_k)).cast("long").alias("retrieved_chunks"),
        )
    )

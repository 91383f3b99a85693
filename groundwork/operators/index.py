"""Chunks, postings and top-k search.

An index is two relations: postings (scope, chunk_id, doc_id, term), one row for each distinct term of
a chunk, and chunks. ``scope`` names the index that a row belongs to, so that one plan serves one
shared index (scope is a constant) and an index a question alike; document frequency and chunk count
are always those of the whole scope, whatever a search filters.

A search of a bounded set of questions in one shared index scores chunks where they stand
(:mod:`groundwork.operators.scan`). Any other joins query terms with postings by term, adds idf up by
(query, chunk) and ranks. Only chunks that share a term ever appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import scan

#: Scores are rounded so far before they are compared: sums of floats have no defined last bit.
DIGITS = 9


def chunk_words(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 160, overlap: int = 32) -> DataFrame:
    """(doc_id, pos, chunk_id, text): windows of words, each ``max_tokens - overlap`` after the last.

    Blank text has no chunk; the last window is the first that reaches the end.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    if overlap < 0 or overlap >= max_tokens:
        raise ValueError("overlap must be at least 0 and below max_tokens")
    stride = max_tokens - overlap

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, pos, cut = [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    w = T.split_words(text) if text else []
                    count = max(1, -(-(len(w) - max_tokens) // stride) + 1) if w else 0
                    row += [k] * count
                    pos += range(count)
                    cut += [" ".join(w[i * stride : i * stride + max_tokens]) for i in range(count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(pos, pa.int32()), pa.array(cut, pa.string())], ["doc_id", "pos", "text"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pos int, text string").select(
        "doc_id", "pos", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("chunk"), F.col("pos").cast("string")).alias("chunk_id"), "text"
    )


def postings(chunks: DataFrame, scope: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(scope, chunk_id, *keep, term) of chunks; ``scope`` defaults to one index for all."""
    own = F.lit(0).cast("long") if scope is None else scope
    return chunks.select(own.alias("scope"), "chunk_id", *keep, F.explode(T.tokens(F.col("text"))).alias("term"))


#: Distinct query terms up to which they are broadcast; beyond, postings are shuffled to them.
BROADCAST_TERMS = 1_000_000


def asked_terms(queries: DataFrame) -> DataFrame:
    """(_at): the distinct terms of all queries, broadcast where their counted number is small."""
    terms = queries.select(F.explode(T.tokens(F.col("question"))).alias("_at")).distinct()
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def asked(post: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that any query asks for; others are dropped before anything is shuffled."""
    return post.join(terms, F.col("term") == F.col("_at"), "left_semi")


def document_frequency(post: DataFrame) -> DataFrame:
    """(scope, term, df)."""
    return post.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, post: DataFrame, n: DataFrame) -> DataFrame:
    """(scope, qid, term, idf) of queries (scope, qid, question); n: (scope, n), chunks of a scope.

    A term that no chunk has counts too.
    """
    q = queries.select("scope", "qid", F.explode(T.tokens(F.col("question"))).alias("term"))
    df = document_frequency(post).select(F.col("scope").alias("_s"), F.col("term").alias("_t"), "df")
    size = n.select(F.col("scope").alias("_ns"), "n")
    return (
        q.join(df, (F.col("scope") == F.col("_s")) & (F.col("term") == F.col("_t")), "left")
        .join(size, F.col("scope") == F.col("_ns"))
        .select("scope", "qid", "term", T.idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    )


def chunk_counts(chunks: DataFrame, scope: Column | None = None) -> DataFrame:
    """(scope, n)."""
    own = F.lit(0).cast("long") if scope is None else scope
    return chunks.select(own.alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def rank(terms: DataFrame, post: DataFrame, top_k: int = 5) -> DataFrame:
    """(qid, rk, chunk_id, score): the best chunks of every query, equal scores by chunk_id.

    score is the share of the query's idf that the chunk's terms have.
    """
    whole = terms.groupBy(F.col("qid").alias("_q")).agg(F.sum("idf").alias("whole"))
    found = (
        terms.select(F.col("scope").alias("_s"), F.col("term").alias("_t"), "qid", "idf")
        .join(post.select("scope", "chunk_id", "term"), (F.col("scope") == F.col("_s")) & (F.col("term") == F.col("_t")))
        .groupBy("qid", "chunk_id")
        .agg(F.sum("idf").alias("part"))
    )
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return (
        found.join(whole, F.col("qid") == F.col("_q"))
        .select("qid", "chunk_id", F.round(F.col("part") / F.col("whole"), DIGITS).alias("score"))
        .withColumn("rk", F.row_number().over(best))
        .where(F.col("rk") <= top_k)
        .select("qid", "rk", "chunk_id", "score")
    )


def only(chunks: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    """Chunks of these documents, or all where none is named; ids travel to the texts while they are few."""
    n = 0 if doc_ids is None else doc_ids.limit(BROADCAST_TERMS + 1).count()
    if not n:
        return chunks
    ids = doc_ids.select(F.col("doc_id").alias("_d")).distinct()
    return chunks.join(F.broadcast(ids) if n <= BROADCAST_TERMS else ids, F.col("doc_id") == F.col("_d"), "left_semi")


def search(queries: DataFrame, chunks: DataFrame, top_k: int = 5, scope: Column | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """(qid, rk, chunk_id, score) for queries (scope, qid, question).

    ``doc_ids`` (doc_id), if it isn't empty, keeps chunks of these documents only. Without a term in
    common, or with ``top_k`` of 0 or less, a query has no row.
    """
    if scope is None and top_k > 0 and (a := scan.asked(queries)) is not None:
        return scan.search(a, chunks, only(chunks, doc_ids), top_k)
    post = asked(postings(chunks, scope), asked_terms(queries))
    terms = query_terms(queries, post, chunk_counts(chunks, scope))
    if doc_ids is not None and not doc_ids.isEmpty():
        post = post.join(doc_ids.select(F.col("doc_id").alias("_d")).distinct(), F.col("doc_id") == F.col("_d"), "left_semi")
    return rank(terms, post, top_k)

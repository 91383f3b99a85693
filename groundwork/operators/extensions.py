"""What the service's interface declares without an algorithm; the choices made here are ours.

Reciprocal rank fusion adds 1 / (60 + rank); BM25 is Okapi's with k1 = 1.2 and b = 0.75; the
resolver takes the reference parser's title from a confidence on, and its year where it has one;
evidence is taken by score while its words fit a budget, a number of chunks a document at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import scan
from groundwork.operators.index import asked, asked_terms

RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75


def fuse(lexical: DataFrame, dense: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, rk, item, score) of two rankings (qid, rk, item)."""
    both = lexical.select("qid", "item", "rk").unionAll(dense.select("qid", "item", "rk"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item"))
    return (
        both.groupBy("qid", "item")
        .agg(F.round(F.sum(1.0 / (RRF_K + F.col("rk"))), 9).alias("score"))
        .withColumn("rk", F.row_number().over(best))
        .where(F.col("rk") <= top_k)
        .select("qid", "rk", "item", "score")
    )


#: Rows of a block of vectors and of a block of queries; a block of each meets in one call.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048
#: Bytes of all query blocks up to which they are broadcast; beyond, blocks meet in a Cartesian product.
BROADCAST_BYTES = 64 << 20
#: Scores are this close or closer where sums of floats in another order are.
SLACK = 2e-6


def _doubles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, dimension) components and which rows are null or hold a null: those are all zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    none = np.array([v is None or None in v for v in col.to_pylist()], bool) if col.null_count or col.flatten().null_count else np.zeros(len(col), bool)
    sound = col.filter(pa.array(~none)) if none.any() else col
    size = len(sound.flatten()) // max(1, len(sound))
    if len(sound) and (np.diff(sound.offsets.to_numpy()) != size).any():
        raise ValueError("vectors differ in dimension")
    out = np.zeros((len(col), size))
    out[~none] = sound.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sound), size)
    return out, none


def _packed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(keys, dim, vecs, none): blocks of at most ``rows`` rows; those without a key meet nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            keys = t.column(0).combine_chunks()
            vecs, none = _doubles(t.column(1))
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([lists, pa.array([vecs.shape[1]], pa.int32()), pa.array([vecs.tobytes()], pa.binary()), pa.array([none.tobytes()], pa.binary())], ["keys", "dim", "vecs", "none"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if n and n + part.num_rows > rows:
                    yield block()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block()

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(key).isNotNull()).select(key, "vec").mapInArrow(each, f"keys array<{kind}>, dim int, vecs binary, none binary")


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _block_best(q: np.ndarray, q_none: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_none: np.ndarray, ids: np.ndarray, top_k: int):
    """(query row, vector row, score): the best ``top_k`` of a block of vectors for each query of a block.

    Of equal vectors only the least ids can be among them, so each vector is compared once. Matrix
    products choose what may be among the best; those scores are added up anew in order. NaN (a zero
    vector) sorts first and null, as -inf, last.
    """
    spare = top_k + int(np.unique(ids, return_counts=True)[1].max())  # a query never meets its own id
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(np.column_stack([v, v_none])).view(np.dtype((np.void, 8 * (v.shape[1] + 1)))).ravel()
    _, first, of = np.unique(raw[order], return_index=True, return_inverse=True)
    of = of.ravel()
    by = np.argsort(of, kind="stable")  # rows class by class, by id
    start = np.searchsorted(of[by], np.arange(len(first)))
    size = np.minimum(np.diff(np.append(start, len(by))), spare)
    one, one_none = v[order[first]], v_none[order[first]]
    with np.errstate(all="ignore"):
        vv, qq = _dot(one, one), _dot(q, q)
        for at in range(0, len(q), 128):
            part = slice(at, at + 128)
            rough = (q[part] @ one.T) / np.sqrt(qq[part, None] * vv[None, :])
            rough[np.isnan(rough)] = np.inf
            rough[:, one_none] = -np.inf
            rough[q_none[part]] = -np.inf
            least = np.partition(rough, -spare, axis=1)[:, -spare, None] if rough.shape[1] > spare else np.full((len(rough), 1), -np.inf)
            row, cls = np.nonzero(rough >= least - SLACK)
            score = np.empty(len(row))
            for k in range(0, len(row), 1 << 16):
                i, j = row[k : k + (1 << 16)] + at, cls[k : k + (1 << 16)]
                score[k : k + (1 << 16)] = np.where(q_none[i] | one_none[j], -np.inf, _dot(q[i], one[j]) / np.sqrt(qq[i] * vv[j]))
            many = size[cls]
            row, score = np.repeat(row, many) + at, np.repeat(score, many)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            item = order[by[np.repeat(start[cls], many) + inner]]
            other = ids[item] != q_ids[row]
            row, score, item = row[other], score[other], item[other]
            fine = np.isfinite(score)
            key = np.where(np.isnan(score), np.inf, score)
            key[fine] = scan.half_up(score[fine], 6)
            best = np.lexsort((ids[item], -key, row))
            row, score, item = row[best], score[best], item[best]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < top_k
            yield row[keep], item[keep], score[keep]


def nearest(queries: DataFrame, vectors: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, rk, item, score): exact cosine neighbours of a stated set of queries (qid, vec).

    All pairs are compared, block by block: a task holds a block of vectors and one of queries and keeps
    the best ``top_k`` of each query, from which the best of all blocks are taken.
    """
    n = vectors.sparkSession.sparkContext.defaultParallelism
    if vectors.rdd.getNumPartitions() < n:
        vectors = vectors.repartition(n)
    item_kind, qid_kind = vectors.schema["item"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    v = _packed(vectors, "item", VECTOR_BLOCK)
    q = _packed(queries, "qid", QUERY_BLOCK).toDF("_keys", "_dim", "_vecs", "_none")
    size = q.agg(F.sum(F.length("_vecs"))).first()[0] or 0
    met = v.crossJoin(F.broadcast(q) if size <= BROADCAST_BYTES else q)

    def names(a: pa.Array) -> np.ndarray:
        x = a.to_numpy(zero_copy_only=False)
        return x.astype(str) if x.dtype == object else x

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                items, dim, vecs, none, qids, q_dim, q_vecs, q_none = (batch.column(c)[r] for c in range(8))
                items, qids, dim, q_dim = items.values, qids.values, dim.as_py(), q_dim.as_py()
                if dim and q_dim and dim != q_dim:
                    raise ValueError("vectors differ in dimension")
                size = dim if q_dim else q_dim
                a = [np.frombuffer(x.as_buffer(), np.float64).reshape(len(k), d)[:, :size] for x, k, d in ((q_vecs, qids, q_dim), (vecs, items, dim))]
                b = [np.frombuffer(x.as_buffer(), bool) for x in (q_none, none)]
                for row, item, score in _block_best(a[0], b[0], names(qids), a[1], b[1], names(items), top_k):
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), items.take(pa.array(item)), pa.array(score)], ["qid", "item", "score"])

    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item"))
    return (
        met.mapInArrow(each, f"qid {qid_kind}, item {item_kind}, score double")
        .withColumn("score", F.when(F.col("score") != F.lit(float("-inf")), F.round("score", 6)))
        .withColumn("rk", F.row_number().over(best))
        .where(F.col("rk") <= top_k)
        .select("qid", "rk", "item", "score")
    )


def bm25(queries: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """(qid, rk, chunk_id, score) by Okapi BM25 over content tokens, with their frequency."""
    if top_k > 0 and (a := scan.asked(queries)) is not None:
        return scan.bm25(a, chunks, top_k, BM25_K1, BM25_B)
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)), F.lower), lambda t: T.is_content(t, T.SEARCH_STOP))
    bags = chunks.select("chunk_id", found.alias("bag")).withColumn("size", F.size("bag"))
    each = asked(bags.select("chunk_id", "size", F.explode("bag").alias("term")), asked_terms(queries))
    tf = each.groupBy("chunk_id", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = bags.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    df = tf.groupBy(F.col("term").alias("_d")).agg(F.count(F.lit(1)).alias("df"))
    q = queries.select("qid", F.explode(T.tokens(F.col("question"))).alias("_t"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.col("mean"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return (
        q.join(df, F.col("_t") == F.col("_d"))
        .join(tf, F.col("_t") == F.col("term"))
        .crossJoin(F.broadcast(stats))  # one row
        .groupBy("qid", "chunk_id")
        .agg(F.round(F.sum(weight * F.col("tf") * (BM25_K1 + 1) / norm), 6).alias("score"))
        .withColumn("rk", F.row_number().over(best))
        .where(F.col("rk") <= top_k)
        .select("qid", "rk", "chunk_id", "score")
    )


def resolve(documents: DataFrame, min_confidence: float = 0.8, prefer_reference_year: bool = True, merge_authors: bool = True) -> DataFrame:
    """(doc_id, resolved_title, resolved_authors, resolved_year, resolved_venue, resolution_policy_version)."""
    title = F.when(F.col("grobid_title_confidence") >= min_confidence, F.coalesce("grobid_title", "docling_title")).otherwise(
        F.coalesce("docling_title", "grobid_title")
    )
    none = F.array().cast("array<string>")
    first, second = F.coalesce("docling_authors", none), F.coalesce("grobid_authors", none)
    authors = F.array_distinct(F.concat(first, second)) if merge_authors else F.when(F.size(second) > 0, second).otherwise(first)
    years = ("grobid_year", "docling_year") if prefer_reference_year else ("docling_year", "grobid_year")
    return documents.select(
        "doc_id",
        title.alias("resolved_title"),
        authors.alias("resolved_authors"),
        F.coalesce(*years).alias("resolved_year"),
        F.col("grobid_venue").alias("resolved_venue"),
        F.lit("1.0").alias("resolution_policy_version"),
    )


def budget(hits: DataFrame, min_score: float = 0.1, max_words: int = 400, per_doc: int = 2) -> DataFrame:
    """(qid, rk, chunk_id, words, used) of hits (qid, rk, chunk_id, doc_id, score, text): evidence that fits."""
    ordered = Window.partitionBy("qid", "doc_id").orderBy("rk")
    upto = Window.partitionBy("qid").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hits.where(F.col("score") >= min_score)
        .withColumn("_d", F.row_number().over(ordered))
        .where(F.col("_d") <= per_doc)
        .withColumn("words", F.size(T.words(F.col("text"))).cast("long"))
        .withColumn("used", F.sum("words").over(upto))
        .where(F.col("used") <= max_words)
        .select("qid", "rk", "chunk_id", "words", "used")
    )


def with_parents(chunks: DataFrame) -> DataFrame:
    """Chunks with ``parent_text``, the text of the chunk that ``parent_chunk_id`` names."""
    parent = chunks.select(F.col("chunk_id").alias("_p"), F.col("text").alias("parent_text"))
    return chunks.join(parent, F.col("parent_chunk_id") == F.col("_p"), "left").drop("_p")


def by_author(chunks: DataFrame, author: str) -> DataFrame:
    """Chunks of enriched documents that name an author; others can't be filtered by author yet."""
    return chunks.where(F.col("is_enriched_searchable") & F.array_contains("authors", author))

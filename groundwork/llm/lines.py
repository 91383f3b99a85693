"""Line dedup: windows of lines at every line, so that no repeated passage is too short or badly placed.

A window is the shortest run of at least ``MIN_LINES`` lines and ``MIN_BYTES`` bytes from a line on, or up
to a line. Every run of so many lines and bytes is covered by windows that lie within it, wherever it
stands and whatever surrounds it. The lines of a window whose bytes stand in an earlier place of the corpus,
by (id, position), are removed. A window that recurs in its own text keeps its first place whole; across
texts every line stays at its first place, but what precedes or follows it there may be a repeat itself.
A window of more than ``MAX_LINES`` lines, which is made of blank lines, is none.

Only (id, position, hash) rows are shuffled for the whole corpus. Windows whose hash occurs again
fetch their bytes; within a hash least and greatest bytes are compared, which says that all are
equal, and where they aren't (a collision) the bytes themselves are the key. Counts combine before
the shuffle, so a window in a third of all documents stays cheap; the join that hands the first place
back is one whose hot keys Spark splits.

Defined cases: a null text stays null and an empty one empty; a row with a null id stays as it is
and isn't compared; rows with equal id and text are one document, so none of them loses a window to
another, and rows with equal id and another text lose what stands at an earlier line of either; a text whose every line goes becomes empty; an empty table gives no rows; columns that
aren't id or text are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import arrow, by_position, cut, grown, id_text, limit_batches, own_columns, table

WINDOW = 2
#: A boundary follows a line if the rolling hash's top bits are zero: one line in 2 ** BOUNDARY_BITS.
BOUNDARY_BITS = 2
MIN_LINES, MAX_LINES, MIN_BYTES = 2, 32, 32

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def chunk_hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 1)


def bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """Content-defined chunks (first line, line after the last); dedup() doesn't use them, they are too coarse for short passages."""
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, len(lines))
    rolling, power = h.copy(), 1
    for k in range(1, WINDOW):
        power = power * _BASE % 2**64
        rolling[k:] += h[: len(h) - k] * np.uint64(power)
    ends = np.flatnonzero((rolling * _MIX) >> np.uint64(64 - BOUNDARY_BITS) == 0) + 1
    out, a = [], 0
    for e in [*ends.tolist(), len(lines)]:
        while e - a > MAX_LINES:
            out.append((a, a + MAX_LINES))
            a += MAX_LINES
        if e - a >= MIN_LINES or e == len(lines) and e > a:
            out.append((a, e))
            a = e
    return out


def windows(lines: list[bytes]) -> dict[int, tuple[int, int]]:
    """Place -> (first line, line after the last).

    The place is twice the first line of the shortest window from there, and one more than twice the
    line after the last of the shortest one up to there, if that isn't also the shortest from its
    first line. Which of the two it is depends on the bytes alone, so places of equal windows compare.
    """
    n = len(lines)
    size = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lines), np.int64, n) + 1)))
    end = np.maximum(np.searchsorted(size, size[:n] + MIN_BYTES + 1), np.arange(n) + MIN_LINES)
    ok = np.flatnonzero((end <= n) & (end - np.arange(n) <= MAX_LINES))
    out = {2 * a: (a, e) for a, e in zip(ok.tolist(), end[ok].tolist(), strict=True)}
    start = np.minimum(np.searchsorted(size, size - MIN_BYTES - 1, "right") - 1, np.arange(n + 1) - MIN_LINES)
    ok = np.flatnonzero((start >= 0) & (np.arange(n + 1) - start <= MAX_LINES))
    for a, e in zip(start[ok].tolist(), ok.tolist(), strict=True):
        if int(end[a]) != e:
            out[2 * e + 1] = (a, e)
    return out


def chunks(text: str | None) -> list[tuple[int, int, bytes]]:
    """(place, line after the last, bytes) of the windows of a text."""
    if not text or "\n" not in text:
        return []
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return [(at, e, b"\n".join(lines[a:e])) for at, (a, e) in windows(lines).items()]


def without(text: str, gone: set[int]) -> str:
    """The text without the windows at the places ``gone``."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    found = windows(lines)
    keep = np.ones(len(lines), bool)
    again = set()
    for at in gone:
        a, e = found[at]
        keep[a:e] = False
        again.add(tuple(lines[a:e]))
    for at, (a, e) in found.items():
        if at not in gone and tuple(lines[a:e]) in again:
            keep[a:e] = True
    return b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k).decode("utf-8", "surrogatepass")


def _places(docs: DataFrame) -> DataFrame:
    """(id, t, at, h): every window's place and hash; t is the text's hash."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at, h = [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for a, _, data in chunks(text):
                row.append(k)
                at.append(a)
                h.append(chunk_hash(data))
        own = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(own), batch.column(1).take(own), pa.array(at, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))],
            ["id", "t", "at", "h"],
        )

    return arrow(docs.select("id", "t", "text"), each, "id long, t long, at int, h long", 256)


def _bytes(docs: DataFrame) -> DataFrame:
    """(id, t, at, h, data) of the windows whose places ``need`` lists."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, (text, need) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            wanted = set(need)
            rows += [(k, a, data) for a, _, data in chunks(text) if a in wanted]
        h = np.array([chunk_hash(d) for _, _, d in rows], np.uint64).view(np.int64)
        own, at, data = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary())))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(own), batch.column(1).take(own), at, pa.array(h), data], ["id", "t", "at", "h", "data"]
        )

    return arrow(docs.select("id", "t", "text", "need"), each, "id long, t long, at int, h long, data binary", 256)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, at): windows, by place, whose bytes stand in an earlier place."""
    texts = id_text(docs, id_col, text_col).where("id IS NOT NULL").select("id", F.xxhash64("text").alias("t"), "text")
    places = cut(_places(texts), "line-places")
    again = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("h").alias("_h"))
    twice = places.join(again, F.col("h") == F.col("_h")).select("id", "t", "at")
    need = twice.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("at").alias("need"))
    wanted = texts.join(grown(need), (F.col("id") == F.col("_id")) & (F.col("t") == F.col("_t")))
    data = cut(_bytes(wanted), "line-bytes")
    first = F.min(F.struct("id", "at")).alias("first")
    by_hash = cut(
        data.groupBy(F.col("h").alias("_h")).agg((F.min("data") == F.max("data")).alias("equal"), first), "line-first"
    )
    later = F.struct("id", "at") > F.col("first")
    plain = data.select("id", "t", "at", "h").join(by_hash.where("equal"), F.col("h") == F.col("_h")).where(later).select("id", "t", "at")
    odd = by_hash.where(~F.col("equal")).select("_h")
    if odd.isEmpty():  # else all bytes are shuffled once more for nothing
        return plain.distinct()
    collided = data.join(odd, F.col("h") == F.col("_h")).select("id", "t", "at", "data")
    exact = collided.groupBy(F.col("data").alias("_data")).agg(first)
    rest = collided.join(exact, F.col("data") == F.col("_data")).where(later)
    return plain.unionAll(rest.select("id", "t", "at")).distinct()


def _dedup(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` by position, with ``text``, what is left, and ``removed``, the windows' places (null: none); and its id and text."""
    limit_batches(docs.sparkSession)
    gone = repeats(docs, id_col, text_col).groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("at").alias("removed"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None else without(t, set(r)) for t, r in zip(texts, removed, strict=True)], dtype=object)

    rows, i, t = by_position(docs, id_col, text_col)
    same = (F.col(i).cast("long") == F.col("_id")) & (F.xxhash64(t) == F.col("_t"))
    out = rows.join(grown(gone), same, "left").drop("_id", "_t")
    loses = F.col("removed").isNotNull()
    left = rest(F.when(loses, F.col(t)), F.col("removed"))  # other texts don't go to Python
    return out.withColumn("text", F.when(loses, left).otherwise(F.col(t))), i, t


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, without the windows of lines that stand in an earlier place."""
    out, _, t = _dedup(docs, id_col, text_col)
    return own_columns(out.withColumn(t, F.col("text")), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, i, t = _dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select(
        F.col(i).alias("doc_id"),
        "text",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        (F.octet_length(t) - F.octet_length("text")).cast("long").alias("n_removed_bytes"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )

"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are collapsed to one class. Each class gets, in each of ``tables`` tables, the signs
of ``bits`` projections on fixed random hyperplanes; classes with the same signs in a table meet in
its bucket, where the cosine of every pair is taken in double precision. A pair that meets in
several tables counts only in the first, so links are counted without emitting pairs; per bucket
come back one count per class and the links that span the bucket's components. Large buckets are
split into blocks (:func:`groundwork.llm.common.blocked`).

For a pair at cosine c the chance to meet is 1 - (1 - (1 - acos(c) / pi) ** bits) ** tables: with the
defaults 0.988 at 0.95 and 0.9999 at 0.98.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing and is kept; vectors of different length never link; repeated rows of one (id, vector) are
one vector with several result rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import Forest, arrow, blocked, bounded, by_position, components, cut, key_groups, table

TABLES, BITS, SEED = 16, 13, 20240


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(n, tables) signs of the projections, packed."""
    signs = (x @ planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(col: pa.Array) -> list[np.ndarray | None]:
    """Rows as float64 vectors, None for those that link with nothing."""
    out = []
    for v in col:
        values = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                if np.isfinite(x).all() and x.any():
                    values = x
        out.append(values)
    return out


def _digests(df: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [
            None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
            for x in _vectors(batch.column(1))
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary())], ["id", "vec", "digest"]
        )

    kind = df.schema["vec"].dataType.simpleString()
    return arrow(df, each, f"id long, vec {kind}, digest binary")


def _entries(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """A row for each class and table."""

    def each(batch: pa.RecordBatch):
        rep, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vecs = _vectors(batch.column(2))
        dims = np.array([len(v) for v in vecs])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack([vecs[i] for i in at])
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and keeps squares finite
            sig = signatures(x, tables, bits)
            key = (sig.T + (np.arange(tables)[:, None] << bits)).reshape(-1) + (int(dim) << 40)
            raw = [row.tobytes() for row in x]
            sigs = [row.tobytes() for row in sig.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array(np.tile(rep[at], tables)),
                    pa.array(np.tile(size[at], tables)),
                    pa.array(raw * tables, pa.binary()),
                    pa.array(sigs * tables, pa.binary()),
                ],
                ["key", "rep", "size", "vec", "sigs"],
            )

    return arrow(classes, each, "key long, rep long, size long, vec binary, sigs binary")


def _found(entries: DataFrame, threshold: float, tables: int, bits: int) -> DataFrame:
    """(a, b null, n): links of class a found in a bucket; (a, b, n null): spanning links."""

    def compare(batches):
        for t, starts in key_groups(batches, ["key", "blk"], 512):
            key, rep, size, side = (t[c].to_numpy() for c in ("key", "rep", "size", "side"))
            vec, sigs = t["vec"].combine_chunks(), t["sigs"].combine_chunks()
            out_a, out_b, out_n = [], [], []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                mid = s + int(np.searchsorted(side[s:e], 1))
                if e - s < 2 or mid == s:
                    continue
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in vec[s:e]])
                sig = np.stack([np.frombuffer(v.as_buffer(), "<i4") for v in sigs[s:e]])
                norm = np.sqrt((x * x).sum(axis=1))
                own = (int(key[s]) & ((1 << 40) - 1)) >> bits
                rows = slice(0, mid - s)
                cols = slice(mid - s, e - s) if mid < e else rows
                ok = x[rows] @ x[cols].T >= threshold * norm[rows, None] * norm[None, cols]
                i, j = np.nonzero(ok)
                if mid < e:
                    j = j + (mid - s)
                else:
                    i, j = i[i < j], j[i < j]
                if own and len(i):  # a pair counts in the first table in which it meets
                    first = np.ones(len(i), bool)
                    for k in range(own):
                        first &= sig[i, k] != sig[j, k]
                    i, j = i[first], j[first]
                if not len(i):
                    continue
                n = np.bincount(i, size[s + j], e - s) + np.bincount(j, size[s + i], e - s)
                has = np.flatnonzero(n)
                out_a.append(rep[s + has])
                out_b.append(np.full(len(has), -1))
                out_n.append(n[has].astype(np.int64))
                span = Forest(e - s)
                span.add(i, j)
                i, j = span.links()
                out_a.append(rep[s + i])
                out_b.append(rep[s + j])
                out_n.append(np.full(len(i), -1))
            if out_a:
                a, b, n = (np.concatenate(v) for v in (out_a, out_b, out_n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b, mask=n >= 0), pa.array(n, mask=n < 0)], ["a", "b", "n"]
                )

    units = blocked(entries, "key", "rep", 1024).repartition("key", "blk").sortWithinPartitions("key", "blk", "side")
    return bounded(units, compare, "a long, b long, n long")


def embedding_links(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    tables: int = TABLES,
    bits: int = BITS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; see the module for the defined cases."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    named, i, v = by_position(df, id_col, vec_col)
    rows = _digests(named.select(F.col(i).cast("long").alias("id"), F.col(v).alias("vec")))
    ids = cut(rows.select("id", "digest"), "emb-id")
    ok = ids.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).distinct()
    classes = cut(ok.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "emb-class")
    reps = (
        rows.join(classes.select("rep", "size", F.col("digest").alias("_d")), (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("_d")))
        .dropDuplicates(["rep", "digest"])
        .select("rep", "size", "vec")
    )
    entries = cut(_entries(reps, tables, bits), "emb-entry")
    found = cut(_found(entries, threshold, tables, bits), "emb-found")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("more"))
    comps = components(found.where(F.col("b").isNotNull()).select("a", "b"), "emb-cc")
    placed = (
        classes.join(counts, F.col("rep") == F.col("_a"), "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("digest").alias("_d"),
            (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return ids.join(placed, F.col("digest") == F.col("_d"), "left").select(
        "id",
        F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_links(table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id")

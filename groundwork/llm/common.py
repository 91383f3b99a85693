"""What the operators of this subpackage share: shared storage, components, bounded key groups.

Executors may be lost at any time, so whatever a plan reads twice is written to the shared folder
that the session names in ``spark.checkpoint.dir`` and read back (:func:`cut`).
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python.
BATCH_BYTES = f"{8 << 20}b"
#: Spark's own default, of which a dozen copies don't fit an executor.
SPARK_BYTES = f"{64 << 20}b"
#: Most rows of one key that one task compares at a time; larger keys are split into blocks.
BLOCK_ROWS = 2048


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; where it is unset, a folder of the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/groundwork-scratch"
    return root if "://" in root or not root.startswith("/") else "file://" + root


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote; nothing may read it afterwards."""
    remove(df.sparkSession, getattr(df, "_cut_path", None))


def remove(spark: SparkSession, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches of bounded bytes, however long the rows are; a larger row comes alone."""
    limit_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(each, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds none for it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def limit_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to Python, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARK_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str, rows: int = 1024
) -> DataFrame:
    """mapInArrow with a function of one batch of at most ``rows`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                out = fn(batch.slice(k, rows))
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return bounded(df, each, schema)


def grown(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the corpus: never broadcast, so that a plan is the same at every size."""
    return df.hint("merge")


def by_position(df: DataFrame, *names: str) -> tuple:
    """``df`` with columns c0, c1, ... and what ``names`` are called there; so no name of a caller's clashes with ours.

    A name is found as it is written, else in any case.
    """
    cols = df.columns
    low = [c.lower() for c in cols]
    at = [cols.index(n) if n in cols else low.index(n.lower()) for n in names]
    return df.toDF(*[f"c{k}" for k in range(len(cols))]), *[f"c{k}" for k in at]


def own_columns(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` of a frame made from :func:`by_position`, under their names."""
    return out.select(*[f"c{k}" for k in range(len(like.columns))]).toDF(*like.columns)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text) of every row."""
    rows, i, t = by_position(docs, id_col, text_col)
    return rows.select(F.col(i).cast("long").alias("id"), F.col(t).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- groups of one key


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``keys`` -> tables of whole groups and the row at which each group starts.

    At least ``least`` rows come at a time, so small groups share one numpy call; never more than
    that, one batch and one group are held.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        new = np.zeros(n, bool)
        if n:
            new[0] = True
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
                t = t.slice(at[-1])
            held, rows = t.to_batches(), t.num_rows
            # a group that goes on keeps growing the need, so that it isn't scanned anew each time
            least = max(least, 2 * rows) if len(at) == 1 else 4096
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def blocked(df: DataFrame, key: str, member: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``blk`` (long) and ``side`` (0 or 1): what has to meet within one (key, blk).

    A key of up to ``block_rows`` rows is one block, side 0. The rows of a larger key are dealt over
    g hashed blocks, and each pair of blocks (a <= b) becomes a unit of work of at most about two
    blocks: rows of block a have side 0 and rows of block b side 1, and only pairs across the sides
    are to be compared (within the side, where a = b). No task ever holds a whole large group, and
    no pair is lost. ``df`` is read twice, so pass something that :func:`cut` wrote.
    """
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > block_rows)
        .select(F.col(key), F.ceil(F.col("_n") / block_rows).cast("long").alias("_g"))
    )
    out = df.join(hot, key, "left")
    g = F.coalesce(F.col("_g"), F.lit(1))
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), g)
    other = F.sequence(F.lit(0).cast("long"), g - 1)
    pairs = F.transform(
        other,
        lambda o: F.struct(
            (F.least(own, o) * g + F.greatest(own, o)).alias("blk"),
            F.when(own > o, 1).otherwise(0).alias("side"),
        ),
    )
    return out.select(*df.columns, F.explode(pairs).alias("_p")).select(*df.columns, "_p.blk", "_p.side")


# ---------------------------------------------------------------- components


class Forest:
    """Links that span the components of n nodes, gathered from any number of calls."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, a: np.ndarray, b: np.ndarray, step: int = 4096) -> None:
        """Take links a[i], b[i]. Those within a component so far are dropped by array operations."""
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            new = np.flatnonzero(self.root[x] != self.root[y])
            if not len(new):
                continue
            up: dict[int, int] = {}
            for u, v in zip(x[new].tolist(), y[new].tolist(), strict=True):
                r, s = int(self.root[u]), int(self.root[v])
                while r in up:
                    r = up[r]
                while s in up:
                    s = up[s]
                if r != s:
                    up[max(r, s)] = min(r, s)
                    self.a.append(u)
                    self.b.append(v)
            to = np.arange(len(self.root))
            for r in sorted(up):  # the lesser is final by then
                to[r] = to[up[r]]
            self.root = to[self.root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(self.a, np.int64), np.asarray(self.b, np.int64)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a long, b long) -> (node, component), the least node.

    Each node but the least of its component has a row.

    Alternates the large-star and the small-star step until nothing changes; each round is written
    to the shared folder. Null ends, loops and
    repeated links are ignored. The driver only ever sees one count and one checksum a round.
    """
    now = cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    seen = _state(now)
    if seen[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    k = 0
    while True:
        k += 1
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
        # large star: larger neighbours of c go to the least of c's neighbourhood
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: c and its smaller neighbours go to the least of them
        large = cut(large, f"{name}-{k}l")
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (
            large.join(low, F.col("u") == F.col("c"))
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        new = cut(small, f"{name}-{k}s")
        discard(now)
        discard(large)
        now, state = new, _state(new)
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1] or 0

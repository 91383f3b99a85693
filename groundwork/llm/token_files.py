"""Token-ID binary output: flat files of unsigned ids with 64-bit document offsets, memory-mapped.

Documents are dealt out by ranges of their id and sorted, so shard k holds smaller ids than shard
k + 1. A shard is three files: ``.ids`` (flat little-endian unsigned ids), ``.off`` (one more 64-bit
offset than documents, counted from the shard's start) and ``.doc`` (64-bit document ids, null ones
first and counted in the index). Where a shard starts in the whole corpus follows from a prefix sum
over the shards' totals. A file's name holds the attempt that wrote it and only the attempts that
Spark accepted are listed in the index, so a task that runs again leaves nothing behind that counts.

Defined cases: a null or empty text holds the end id alone; rows with equal ids stay next to each
other, ordered by their texts' hash, then text; a null id sorts first; an empty table writes no
shard; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.llm.common import bounded, cut, id_text, partitions, scratch, table
from groundwork.llm.tokens import closed, default_tokenizer, encoder

INDEX = "shard int, stem string, dtype string, docs long, nulls long, tokens long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """Write the shards below ``path`` and return their index with ``base``, the ids before each shard."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        stem = f"{path}/{shard:06d}-{uuid.uuid4().hex[:8]}"
        fs, at = _open(stem)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        enc = encoder(tokenizer)
        docs_n = nulls = tokens = 0
        with fs.open_output_stream(f"{at}.ids") as ids, fs.open_output_stream(f"{at}.off") as off, fs.open_output_stream(f"{at}.doc") as doc:
            off.write(np.zeros(1, "<i8").tobytes())
            batch: pa.RecordBatch | None = first
            while batch is not None:
                got, at = closed(enc, batch.column(1), end_id)
                ids.write(got.tobytes())
                off.write((tokens + at[1:]).astype("<i8").tobytes())
                doc.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs_n, tokens, nulls = docs_n + batch.num_rows, tokens + int(at[-1]), nulls + batch.column(0).null_count
                batch = next(batches, None)
        row = {"shard": [shard], "stem": [stem], "dtype": [enc.dtype.str], "docs": [docs_n], "nulls": [nulls], "tokens": [tokens]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("stem", pa.string()), ("dtype", pa.string()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    rows = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards or partitions(spark), "id", "tie").sortWithinPartitions("id", "tie", "text")
    index = cut(bounded(rows.select("id", "text"), write, INDEX), "token-index")
    # a row a shard: the window's one partition is as long as there are shards
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


class Shard:
    """A shard's files, memory-mapped where they are local."""

    def __init__(self, stem: str, dtype: str, nulls: int = 0) -> None:
        self.nulls = nulls
        self.ids, self.offsets, self.docs = self._map(f"{stem}.ids", dtype), self._map(f"{stem}.off", "<i8"), self._map(f"{stem}.doc", "<i8")

    @staticmethod
    def _map(uri: str, dtype: str) -> np.ndarray:
        fs, at = _open(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            with pa.memory_map(at) as f:
                return np.frombuffer(f.read_buffer(), dtype)
        with fs.open_input_file(at) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]


def read_tokens(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files; ``ids`` on demand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["stem"], row["dtype"], row["nulls"])
                off = shard.offsets
                for a in range(0, len(shard), 1024):
                    b = min(a + 1024, len(shard))
                    crc = [zlib.crc32(shard[k].astype("<u4").tobytes()) for k in range(a, b)]
                    cols = [
                        pa.array(shard.docs[a:b], mask=np.arange(a, b) < shard.nulls),
                        pa.array(row["base"] + off[a:b]),
                        pa.array(off[a + 1 : b + 1] - off[a:b]),
                        pa.array(crc, pa.int64()),
                    ]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([shard[k].tolist() for k in range(a, b)], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = partitions(index.sparkSession)
    return bounded(index.repartition(n, "shard"), read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"))
    return read_tokens(index).withColumnRenamed("id", "doc_id")

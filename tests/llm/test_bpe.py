import hashlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from groundwork.llm import bpe

RANKS = bpe.read_ranks(bpe.default_ranks())
ODD = ["", None, " ", "  a", "a  b \n", "don't we'll", "é漢字🙂 x", "\x00\x01 \x1c", "aaaaaaaa", "1234 12.5%", "x" * 300, "a\n\nb", "'s 't", "a\x85b \x1c\u200b", "word " * 30_000, "q" * 3000, "\u0870\u0889 a\U00031350b 1\U0001e4f0 a\U00011bf5"]
S = "doc_id long, text string, words string, docs int, id double"


def engine():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("size", [bpe.HEAD, 20, 0])
def test_same_ids_as_the_library(spark, monkeypatch, size):
    monkeypatch.setattr(bpe, "HEAD", size)
    enc = engine()
    rows = [(k, t, "", 0, 0.0) for k, t in enumerate(ODD)] + [(None, "a b", None, None, None), (3, "  a", "", 0, 0.0)]
    if size > 40:
        rows += [(1000 + r.doc_id, r.text, "", 0, 0.0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, S)
    got = bpe.encode(docs, keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = enc.encode_ordinary(texts[r.id])
        assert r.ids == ids and r.decoded == texts[r.id].encode() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.id].encode()).hexdigest()


def test_settled_ranges(spark):
    ranges = [(0, 0x51F), (0x2010, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    edges = {k + d for r in ranges for k in r for d in (-1, 0, 1)} | {0xFFFF, 0x10000, 0x1F642, 0x10FFFF}
    texts = {f"{a}{chr(k)}{b}": any(x <= k <= y for x, y in ranges) for k in edges if k >= 0 for a in ("", "é\n", "“") for b in ("", "z漢\n")}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in rows.select("t", bpe.settled(F.col("t")).alias("ok")).collect()} == texts


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], S)).count() == 0

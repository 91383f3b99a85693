import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundwork.llm import packing, token_files, tokens
from groundwork.llm.tokens import Encoder, default_tokenizer

SF = "/root/testdata/sf0.001"
PLAIN = Tokenizer.from_file(default_tokenizer())
ENC = Encoder(default_tokenizer())
S = "doc_id long, text string, id string, rank int, length double"


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["", "\n", " a", "a ", "a  b", "a\tb  c", "\n\nfoo", "x\n\ny z", "a\x1cb c", "a\xa0b", "<|endoftext|> b", "a\0b c", " \n a", "don't 's\n'll", "é\r\nb", "aaaaa aaaaaaaaa", "x" * 5000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENC.encode(pa.array([text]))[0].tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 1\n\t.é'sÀ漢  "), max_size=40))
def test_same_ids_as_the_library(text):
    assert ENC.encode(pa.array([text]))[0].tolist() == ids_of(text)


def test_files(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    start, want = 0, {}
    for i in sorted(docs):
        ids = [*ids_of(docs[i]), 2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = token_files.query(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_files_edges(spark, tmp_path):
    rows = [(3, "b c", "", 1, 0.0), (None, "x", "", 1, 0.0), (3, "b c", "", 1, 0.0), (1, None, None, None, None), (2, "w " * 60000, "", 1, 0.0)]
    index = token_files.write_tokens(spark.createDataFrame(rows, S), f"file://{tmp_path}/t").cache()
    got = sorted(token_files.read_tokens(index, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1, 2, 3, 3]
    assert [r.ids for r in got] == [[*ids_of(t), 2] for t in ("x", "", "w " * 60000, "b c", "b c")]
    assert [r.start for r in got] == np.cumsum([0, *[len(r.ids) for r in got]])[:-1].tolist()
    empty = token_files.write_tokens(spark.createDataFrame([], S), f"file://{tmp_path}/e")
    assert token_files.read_tokens(empty).count() == 0


def check_packs(rows, docs, size):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.id, []).append(r)
    for v in by_seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by_seq) == list(range(len(by_seq)))
    for i, text in docs.items():
        ids = [*ids_of(text), 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    return by_seq


def test_pack_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_packs(rows, docs, 2048)
    padding = {r.sequence_id: r.padding for r in rows}
    assert sum(padding.values()) < 0.02 * sum(r.length for r in rows)
    assert packing.query(spark, SF).columns[:2] == ["doc_id", "start"]


def test_pack_edges(spark):
    rows = [(1, None, "", 1, 0.0), (2, "", "", 1, 0.0), (3, "a b c " * 9, "", 1, 0.0), (4, "x", None, None, None)]
    docs = {r[0]: r[1] for r in rows}
    check_packs(packing.pack(spark.createDataFrame(rows, S), size=8).collect(), docs, 8)
    assert packing.pack(spark.createDataFrame([], S)).count() == 0


def test_workers_forget_after_packing(spark):
    rows = [(k, f"some words {k} and others", "", 1, 0.0) for k in range(500)]
    packing.pack(spark.createDataFrame(rows, S)).count()

    def held(batches):
        for _ in batches:
            pass
        n = [len(e.young) + len(e.old) for e in tokens._encoders.values()]
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    found = [r.n for r in spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect()]
    assert found and not any(found)  # the same workers serve both


def test_small_cache_gives_the_same_ids():
    enc = Encoder(default_tokenizer())
    enc.cache = 3
    text = "one two three four five, one six seven é two"
    for _ in range(3):
        assert enc.encode(pa.array([text]))[0].tolist() == ids_of(text)
        assert max(len(enc.young), len(enc.old)) <= 3


def test_memory_of_a_batch():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(340)) for _ in range(4000)])
    ENC.encode(texts)
    tracemalloc.start()
    ENC.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * texts.nbytes


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=30))
def test_patterns_place_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 40)
    got = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 40
        for x in lengths:
            got[x] = got.get(x, 0) + count
    assert got == histogram
    where = packing.slots(patterns)
    used = set()
    for length, n in histogram.items():
        seq, off = packing.place(where, np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            span = {(s, k) for k in range(o, o + length)}
            assert not span & used
            used |= span

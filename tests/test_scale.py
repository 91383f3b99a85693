"""What has to hold at size: the same results by other means than the plain plans, odd rows included."""

import math
import random


from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import extensions, index, qa, scan


def test_nearest_odd_vectors(spark, monkeypatch):
    """Zero vectors (NaN, first), null vectors (null, last), many equal vectors, repeated ids, small blocks."""
    monkeypatch.setattr(extensions, "VECTOR_BLOCK", 16, raising=False)
    monkeypatch.setattr(extensions, "QUERY_BLOCK", 4)
    rng = random.Random(4)
    rows = [(k, [float(rng.randrange(-1, 2)) for _ in range(4)]) for k in range(60)]
    rows += [(100 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(40)] + [(7, [1.0, 1.0, 0.0, 0.0]), (200, None), (201, None), (202, [0.0] * 4), (None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "item long, vec array<float>").repartition(3)
    got = {}
    for r in extensions.nearest(vectors.where("item % 10 = 0").withColumnRenamed("item", "qid"), vectors, 5).orderBy("qid", "rk").collect():
        got.setdefault(r.qid, []).append((r.item, r.score))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))

    def score(a, b):
        if a is None or b is None:
            return None
        length = math.sqrt(dot(a, a) * dot(b, b))
        return round(dot(a, b) / length, 6) if length else math.nan

    place = lambda s: math.inf if s is None else -math.inf if math.isnan(s) else -s
    for q, a in rows:
        if q is not None and q % 10 == 0:
            want = sorted(((score(a, b), i) for i, b in rows if i is not None and i != q), key=lambda x: (place(x[0]), x[1]))[:5]
            assert str(got[q]).replace("-0.0)", "0.0)") == str([(i, s) for s, i in want]).replace("-0.0)", "0.0)")


def odd_texts():
    rng = random.Random(6)
    letters = ["a", "b", "Z", "7", ".", "-", "%", " ", "\n", "\x1c", "\u00a0", "\u0130", "\u212a", "\u00e9", "_", "the", "foxes", "x1", "3.5%"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "a. b- the.", "end. Next"]


def test_tokens_of_bytes_are_those_of_columns(spark):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.tokens(F.col("t")).alias("tok")).collect()
    terms = sorted({t for r in rows for t in r.tok or []})
    row, term, tf, size = scan.Words(terms).of(texts)
    got = {}
    for k, t in zip(row.tolist(), term.tolist(), strict=True):
        got.setdefault(k, set()).add(terms[t])
    assert {r.k: set(r.tok) for r in rows if r.tok} == got and size.sum() == tf.sum()


def test_words_of_python_are_those_of_columns(spark):
    texts = [t or "" for t in odd_texts()]
    for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.words(F.col("t")).alias("w")).collect():
        assert T.split_words(texts[r.k]) == r.w


def test_scan_ranks_as_postings_do(spark, monkeypatch):
    """Many equal scores, more chunks than a call takes; the search shuffles no posting."""
    rng = random.Random(8)
    word = [f"w{k}" for k in range(30)]
    chunks = spark.createDataFrame([(f"{k}:c", k % 7, " ".join(rng.choices(word, k=4))) for k in range(1500)], "chunk_id string, doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(0, k, " ".join(rng.choices(word, k=3))) for k in range(20)] + [(0, 99, "unseen")], "scope long, qid long, question string")
    only = spark.createDataFrame([(1,), (3,)], "doc_id long")
    run = lambda: [sorted(map(str, f.collect())) for f in (index.search(q, chunks, 7), index.search(q, chunks, 3, doc_ids=only), extensions.bm25(q, chunks, 7), qa.trace(q, chunks))]
    plan = index.search(q, chunks, 7)._jdf.queryExecution().toString()
    got = run()
    assert "regexp_extract_all" not in plan
    monkeypatch.setattr(scan, "MOST", 0)
    assert got == run()

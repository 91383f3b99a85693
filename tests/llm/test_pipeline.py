import numpy as np
from test_lines import brute as brute_lines
from test_suffix import brute as brute_spans  # noqa: F401
from test_tokens import check_packs

import corpus_pipeline
from groundwork.llm import suffix, toxicity

SF = "/root/testdata/sf0.001"


def one_of_each(rows):
    """The first of each group of texts that a chain of exact similarities of 0.8 or more joins."""

    def five(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: five(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def without_repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    count, out, n = {}, [], suffix.LENGTH
    for d in raw:
        for k in range(len(d) - n + 1):
            count[d[k : k + n]] = count.get(d[k : k + n], 0) + 1
    for (i, _), d in zip(rows, raw, strict=True):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - n + 1):
            if count[d[k : k + n]] > 1:
                gone[k : k + n] = True
        out.append((i, bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, t) for i, t in rows if model.score(toxicity.features(t)) < toxicity.THRESHOLD]
    assert 0 < len(want) < len(rows)
    want = without_repeats(one_of_each(brute_lines(want)))
    check = {i: t for i, t in want}
    got = corpus_pipeline.run(spark, SF).withColumnRenamed("doc_id", "id").collect()
    assert {r.id for r in got} == set(check)
    check_packs(got, check, 2048)


def test_stages_return_documents(spark):
    s = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], s)
    empty = spark.createDataFrame([], s)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == corpus_pipeline.COLUMNS
        assert stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0

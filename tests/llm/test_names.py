"""Extra columns whose names operators use inside: kept where other columns are kept, ignored elsewhere."""

import pytest

from groundwork.llm import bpe, embedding, lines, ogg, packing, simhash, suffix, token_files, toxicity, urls

ODD = ["_id", "_t", "_own", "_hash", "_spans", "_keep", "_removed", "_gone_id", "_toxicity", "id", "t", "h", "fp", "key", "TEXT", "removed", "c0", "c1", "at", "score", "words"]
LONG = "one two three four five six seven eight nine ten " * 20
ROWS = [(1, LONG), (2, LONG + "x"), (3, "a b\nc d e f g h i j k l m n o p q r s t\nu v w x y z"), (None, None), (4, "")]


def odd(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    more = [c for c in ODD if c not in names]
    return spark.createDataFrame([(*r, *[f"{c}!" for c in more]) for r in rows], schema + ", " + ", ".join(f"`{c}` string" for c in more)), more


@pytest.mark.parametrize("fn", [lines.line_dedup, simhash.near_dedup, suffix.dedup_texts, lambda d: toxicity.clean(d, d.sparkSession.createDataFrame([(1, 0)], "doc_id long, toxic int"))])
def test_other_columns_are_kept(spark, fn):
    docs, more = odd(spark, ROWS, "doc_id long, text string")
    got = fn(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[k + 2] == f"{c}!" for r in rows for k, c in enumerate(more))


@pytest.mark.parametrize(
    "fn",
    [
        simhash.simhash_components,
        suffix.suffix_dedup,
        bpe.encode,
        ogg.store_texts,
        packing.pack,
        lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(1, 0)], "doc_id long, toxic int")),
        lambda d: token_files.read_tokens(token_files.write_tokens(d, token_files.scratch(d.sparkSession, "names"))),
    ],
)
def test_other_columns_are_ignored(spark, fn):
    docs, _ = odd(spark, ROWS, "doc_id long, text string")
    assert fn(docs).count() == fn(spark.createDataFrame(ROWS, "doc_id long, text string")).count()


def test_vectors_and_urls(spark):
    vectors, _ = odd(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(r.n_links for r in embedding.embedding_links(vectors).collect()) == [0, 1, 1]
    pages, _ = odd(spark, [(1, "https://a.com/x"), (None, None)], "page_id long, url string")
    assert urls.filter_urls(pages, spark.createDataFrame([], "id long, good int")).count() == 2

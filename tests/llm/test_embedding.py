import numpy as np

from groundwork.llm import embedding

S = "vec_id long, embedding array<float>, label int, id string"


def brute(ids, x, t=0.95):
    n = np.linalg.norm(x, axis=1)
    ok = (x @ x.T) / np.outer(n, n) >= t
    np.fill_diagonal(ok, False)
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = find(ids[i]), find(ids[j])
        root[max(a, b)] = min(a, b)
    return {v: (int(ok[k].sum()), find(v)) for k, v in enumerate(ids)}


def test_planted_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((20, 64))
    x = np.concatenate([centre, *[centre[:5] + 0.08 * rng.standard_normal((5, 64)) for _ in range(8)], centre[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    want = brute(list(range(len(x))), x.astype(np.float64))
    for block in (2048, 4):
        real = embedding.blocked
        monkeypatch.setattr(embedding, "blocked", lambda df, key, member, n, b=block, f=real: f(df, key, member, b))
        got = {r.id: (r.n_links, r.component_id) for r in embedding.embedding_links(spark.createDataFrame(rows, S)).collect()}
        monkeypatch.setattr(embedding, "blocked", real)
        assert got == want


def test_recall_on_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    want = brute([r.vec_id for r in rows], x)
    got = {r.vec_id: r for r in embedding.query(spark, sf).collect()}
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * links
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edges(spark):
    assert embedding.embedding_links(spark.createDataFrame([], S)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0, ""), (2, [], 0, ""), (3, [0.0, 0.0], 0, ""), (4, [1.0, None], 0, ""), (5, [nan, 1.0], 0, ""),
        (6, [inf, 1.0], 0, ""), (7, [1.0, 2.0], None, None), (8, [2.0, 4.0], 0, ""), (8, [2.0, 4.0], 0, ""), (9, [1.0, 2.0, 0.0], 0, ""),
        (None, [1.0, 2.0], 0, ""), (10, [-0.0, 1.0], 0, ""), (11, [0.0, 1.0], 0, ""),
    ]
    got = embedding.embedding_links(spark.createDataFrame(rows, S)).collect()
    assert len(got) == len(rows)
    by = {r.id: (r.n_links, r.component_id, r.kept) for r in got}
    for i in (1, 2, 3, 4, 5, 6, 9):
        assert by[i] == (0, i, True)
    assert by[7] == (1, 7, True) and by[8] == (1, 7, False) and by[None] == (0, None, True)
    assert by[10] == (1, 10, True) and by[11] == (1, 10, False)

import random

import pytest

from groundwork.llm import lines

S = "doc_id long, text string, id int, at string, h double"


def brute(rows):
    """Rows (id, text) with later places of equal chunks removed."""
    first, found = {}, []
    for i, t in rows:
        found.append([] if i is None else lines.chunks(t))
        for a, _, data in found[-1]:
            first[data] = min(first.get(data, (i, a)), (i, a))
    out = []
    for (i, t), cs in zip(rows, found, strict=True):
        gone = {a for a, _, data in cs if (i, a) > first[data]}
        out.append((i, lines.without(t, gone) if gone else t))
    return out


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    a = [f"line {rng.random()}".encode() for _ in range(200)]
    b = [b"new"] * 3 + a[:100] + [b"inserted"] + a[100:]
    assert [x for s, e in lines.bounds(a) for x in a[s:e]] == a
    ca, cb = ({b"\n".join(x[s:e]) for s, e in lines.bounds(x)} for x in (a, b))
    assert len(ca & cb) >= 0.9 * len(ca)
    assert all(e - s <= lines.MAX_LINES for s, e in lines.bounds([b""] * 500))


@pytest.mark.parametrize("weak", [False, True])
def test_random_corpus(spark, monkeypatch, weak):
    rng = random.Random(1)
    pool = [[f"passage {p} line {k} {'x' * rng.randrange(30)}" for k in range(12)] for p in range(6)]
    rows = []
    for i in range(60):
        text = [f"own {rng.random()}" for _ in range(rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            text += rng.choice(pool)
        rows.append((i, "\n".join([*text, f"end {rng.random()}"])))
    want = brute(rows)
    assert sum(len(t) for _, t in want) < sum(len(t) for _, t in rows)
    sdf = spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], S)
    if weak:  # many collisions: bytes decide

        def places(docs):
            return real_places(docs).withColumn("h", lines.F.col("h") % 3)

        def data(docs):
            return real_bytes(docs).withColumn("h", lines.F.col("h") % 3)

        real_places, real_bytes = lines._places, lines._bytes
        monkeypatch.setattr(lines, "_places", places)
        monkeypatch.setattr(lines, "_bytes", data)
    got = lines.line_dedup(sdf)
    assert got.columns == sdf.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lines.query(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows))


def test_edges(spark):
    assert lines.line_dedup(spark.createDataFrame([], S)).count() == 0
    text = "\n".join(f"some line number {k}" for k in range(40))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, text + "\n" + text)]
    got = lines.line_dedup(spark.createDataFrame([(*r, None, None, None) for r in rows], S)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[None] == [text] and by[3] == [text, text]
    assert by[4] == [""] and by[5] == by[6] == ["\n\n\n\n"] and len(by[7][0]) < len(text)


def all_runs(rows):
    """Rows without the lines of any run of lines, short or long, that stands at an earlier place."""
    places, out = {}, []
    runs = [
        {(a, e): tuple(x[a:e]) for a in range(len(x)) for e in range(a + lines.MIN_LINES, len(x) + 1) if len("\n".join(x[a:e]).encode()) >= lines.MIN_BYTES}
        for x in (t.split("\n") for _, t in rows)
    ]
    for (i, _), found in zip(rows, runs, strict=True):
        for (a, _), data in found.items():
            places[data] = min(places.get(data, (i, a)), (i, a))
    for (i, t), found in zip(rows, runs, strict=True):
        gone = {k for (a, e), data in found.items() if (i, a) > places[data] for k in range(a, e)}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return out


def test_short_runs_are_found(spark):
    rng = random.Random(8)
    pool = [[f"passage {p} line {k} {'x' * rng.randrange(30)}"[rng.randrange(12) :] for k in range(3)] + ["."] * (p % 2) + [f"{p}"] for p in range(30)]
    rows = []
    for i in range(50):
        text = [f"own {rng.random()}"]
        for p in rng.sample(pool, rng.randrange(4)):
            text += [*p[: rng.randrange(1, 6)], f"own {rng.random()}"]
        rows.append((i, "\n".join(text)))
    want = all_runs(rows)
    assert sum(a != b for a, b in zip(rows, want, strict=True)) > 20
    got = lines.line_dedup(spark.createDataFrame([(*r, 0, "", 0.0) for r in rows], S)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want


def test_repeat_in_its_own_text_keeps_its_first_place():
    a, b = "a line of twenty bytes", "another of twenty bytes"
    assert brute([(1, "\n".join([a] * 5))]) == [(1, f"{a}\n{a}")]
    assert brute([(1, "\n".join([a, b] * 3))]) == [(1, f"{a}\n{b}\n{a}")]

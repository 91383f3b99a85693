import numpy as np
import xxhash

from groundwork.llm import simhash
from groundwork.llm.common import components


def slow_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > n)


def brute(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ["", None, " \t\n", "One", "A b C", "a b c d", "Été   ÀB x y z\x0bq\x1cr w", "x " * 70000]:
        assert simhash.fingerprint(t) == slow_fp(t)


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {}
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            fps[len(fps)] = x
    rep = {}
    for i, x in fps.items():
        rep.setdefault(x, i)
    rows = [(int(np.uint64(x).astype(np.int64)), i) for x, i in rep.items()]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = {i: c for i, c in brute({i: x for x, i in rep.items()}).items()}
    for block in (2048, 3):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        got = {r.node: r.component for r in components(simhash.links(df)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_query_on_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: slow_fp(r.text) for r in docs}
    want = brute(fps)
    got = simhash.query(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_edges(spark):
    s = "doc_id long, text string, fp string, id int, component_id string"
    assert simhash.simhash_components(spark.createDataFrame([], s)).count() == 0
    rows = [(1, "a b c d e", "x", 1, ""), (1, "a b c d e", "x", 1, ""), (None, None, None, None, None), (3, "", "", 3, "")]
    got = simhash.simhash_components(spark.createDataFrame(rows, s)).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.id == 1} == {1}
    assert {r.component_id for r in got if r.id != 1} == {3}
    kept = simhash.near_dedup(spark.createDataFrame(rows, s))
    assert kept.columns == ["doc_id", "text", "fp", "id", "component_id"] and kept.count() == 4


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if x != find(x)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_keys_lose_no_pair():
    rng = np.random.default_rng(5)
    for distance in (4, 8):
        masks, segs = simhash._masks(distance), simhash.segments(distance)
        x = rng.integers(0, 2**63, 600, dtype=np.uint64)
        x[300:] = x[:300]
        for k in range(300, 600):
            for bit in rng.integers(0, 64, distance):
                x[k] ^= np.uint64(1 << int(bit))
        low, bits = segs[2]
        x &= ~np.uint64(((1 << bits) - 1) << low)
        want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance), strict=True)}
        chained = {(i, j) for i, j in zip(*simhash.chain_pairs(x, x, 2, distance, masks), strict=True)}
        got = {(i, j) for a, b in simhash.key_pairs(x, x, 2, distance, masks, 5000) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == chained and got <= want
        found = set()  # over all keys every pair is found
        y = rng.integers(0, 2**63, 60, dtype=np.uint64)
        y[30:] = y[:30]
        for k in range(30, 60):
            for bit in rng.integers(0, 64, distance):
                y[k] ^= np.uint64(1 << int(bit))
        for s, (low, bits) in enumerate(segs):
            own = y >> np.uint64(low) & np.uint64((1 << bits) - 1)
            for v in np.unique(own):
                at = np.flatnonzero(own == v)
                i, j = simhash.chain_pairs(y[at], y[at], s, distance, masks)
                found |= set(zip(at[i].tolist(), at[j].tolist(), strict=True))
        assert found == set(zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(y[:, None] ^ y[None, :]) <= distance)), strict=True))


def test_near_dedup_goes_by_exact_similarity(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(300, rng.integers(3, 12), replace=False):
            words[at] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    jac = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(60)}
    want = {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if jac[k] < 0.8}
    assert sum(0.8 <= j < 0.9 for j in jac.values()) > 10 and min(jac.values()) < 0.75
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_near_dedup_takes_its_candidates_from_fingerprints(spark, monkeypatch):
    """With no band shared by any two texts, SimHash alone finds those that differ in few bits."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        rows.append((2 * k, " ".join(words)))
        words[int(rng.integers(0, 400))] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    fps = {i: simhash.majority(simhash.hashes(simhash.shingles(t))) for i, t in rows}
    close = {2 * k + 1 for k in range(30) if (fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= simhash.NEAR_BITS}
    assert len(close) > 25
    none = lambda h: [int(x) for x in np.random.default_rng(int(h[0])).integers(0, 2**63, simhash.BANDS)]
    monkeypatch.setattr(simhash, "band_keys", lambda h: none(h ^ np.uint64(len(h)) ^ np.bitwise_xor.reduce(h)))
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(fps) - close


def test_a_null_id_joins_its_neighbours(spark):
    """Components over fingerprints: what only a null id has still links the ones on either side."""
    import pyspark.sql.functions as F

    fps = [(1, 0), (None, 0b111), (2, 0b11111), (3, 1 << 40 | 0xFF << 20)]
    rows = spark.createDataFrame(fps, "id long, fp long")
    got = {(r.id, r.fp): r.component_id for r in simhash.components_of(rows, 4).select("id", F.col("fp"), "component_id").collect()}
    assert got == {(1, 0): 1, (None, 0b111): 1, (2, 0b11111): 1, (3, 1 << 40 | 0xFF << 20): 3}

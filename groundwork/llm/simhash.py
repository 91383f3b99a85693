"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits. Cut into m = 5 ring segments, two fingerprints that differ in at most
t = 4 bits have a start i such that for every chain length l the segments i .. i+l-1 differ in at
most floor(l * t / m) bits together: 0, 1, 2, 3, 4. The first link of the chain (segment i equal)
is an equi-key, so distinct fingerprints meet by (i, value of segment i); within a key the longer
chains prune candidates before the whole Hamming distance is taken.

Within a key, fingerprints are sorted by the next segment, and only those within its budget of one
more bit are compared at all, so the work of a key is a small share of its pairs.

Equal fingerprints are collapsed to one class before anything is compared. A key of many
fingerprints is split into blocks (:func:`groundwork.llm.common.blocked`), and a task returns only
links that span its components, so no group's pairs are ever emitted.

Defined cases: null or wordless text has fingerprint zero, which links like any other; fewer words
than the shingle length form one shingle; repeated rows share class and component; a null id is
kept, but is never the smallest of a component that has another id; an empty table gives no rows;
other columns are ignored.

:func:`near_dedup`, the pipeline's stage, takes SimHash fingerprints of five-word shingles, finds those within
``NEAR_BITS`` of each other by the same chains, and confirms each such link by exact similarity. Texts that are
similar enough but whose fingerprints lie further apart are found by bands of least hashes, confirmed likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import Forest, arrow, blocked, bounded, by_position, components, cut, grown, id_text, key_groups, own_columns, table

WIDTH = 64
#: Fingerprints of one key that one task compares at a time.
BLOCK_ROWS = 1 << 16
#: Differing bits up to which near_dedup() takes two fingerprints of five-word shingles for a candidate.
NEAR_BITS = 8
#: Least Jaccard similarity at which near_dedup() links, as a fraction.
NEAR = (4, 5)
#: Two texts at 0.8 share one of so many bands of so many least hashes with a chance of 0.9994.
BANDS, ROWS = 32, 7
#: Texts of one band that one task compares at a time.
COMPARE_ROWS = 256

_ODD = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of XXH64 over the word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    counts = np.zeros(WIDTH, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], "<u8").view("<i8")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return arrow(id_text(docs, id_col, text_col), each, "id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of distance + 1 segments of the fingerprint."""
    m = distance + 1
    edges = [WIDTH * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _masks(distance: int) -> list[list[np.uint64]]:
    """masks[i][l - 1]: the bits of the chain of l segments from segment i."""
    segs = segments(distance)
    one = [((1 << n) - 1) << a for a, n in segs]
    out = []
    for i in range(len(segs)):
        chain, row = 0, []
        for k in range(len(segs)):
            chain |= one[(i + k) % len(segs)]
            row.append(np.uint64(chain))
        out.append(row)
    return out


def chain_pairs(x: np.ndarray, y: np.ndarray, seg: int, distance: int, masks: list[list[np.uint64]]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of x and y, which agree in segment ``seg``, that differ in ``distance`` bits at most."""
    m = distance + 1
    gap = x[:, None] ^ y[None, :]
    i, j = np.nonzero(np.bitwise_count(gap & masks[seg][min(1, m - 1)]) <= 2 * distance // m)
    for length in range(3, m + 1):
        ok = np.bitwise_count(gap[i, j] & masks[seg][length - 1]) <= length * distance // m
        i, j = i[ok], j[ok]
    return i, j


def key_pairs(x: np.ndarray, y: np.ndarray, seg: int, distance: int, masks: list[list[np.uint64]], most: int = 1 << 22):
    """The same in parts of at most about ``most`` comparisons, skipping what the second link of the chain excludes."""
    if len(x) * len(y) <= 1 << 16 or distance < 1:
        rows = max(1, most // max(1, len(y)))
        for k in range(0, len(x), rows):
            i, j = chain_pairs(x[k : k + rows], y, seg, distance, masks)
            yield i + k, j
        return
    low, bits = segments(distance)[(seg + 1) % (distance + 1)]
    second = lambda v: (v >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
    by_x, by_y = np.argsort(second(x), kind="stable"), np.argsort(second(y), kind="stable")
    sx, sy = second(x)[by_x], second(y)[by_y]
    values, at = np.unique(sx, return_index=True)
    for v, a, e in zip(values.tolist(), at.tolist(), [*at[1:].tolist(), len(sx)], strict=True):
        near = [v, *(v ^ (1 << b) for b in range(bits))]  # the budget of two segments is one bit
        own = np.concatenate([by_y[np.searchsorted(sy, n) : np.searchsorted(sy, n, "right")] for n in near])
        rows = max(1, most // max(1, len(own)))
        for k in range(a, e, rows):
            part = by_x[k : min(e, k + rows)]
            i, j = chain_pairs(x[part], y[own], seg, distance, masks)
            yield part[i], own[j]


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """classes (fp, rep), distinct fingerprints -> (a, b): links that span each key's components."""
    segs, masks = segments(distance), _masks(distance)
    keyed = classes.select(
        "fp",
        "rep",
        F.explode(
            F.array(
                *[
                    (F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)) * len(segs) + i).cast("long")
                    for i, (a, n) in enumerate(segs)
                ]
            )
        ).alias("key"),
    )

    def compare(batches):
        for t, starts in key_groups(batches, ["key", "blk"]):
            fp = t["fp"].to_numpy().view(np.uint64)
            rep, side, key = (t[c].to_numpy() for c in ("rep", "side", "key"))
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if e - s < 2:
                    continue
                mid = s + int(np.searchsorted(side[s:e], 1))
                across = mid < e and mid > s
                if mid == s:  # rows of the second side alone: their partners' block is empty
                    continue
                x, lo = fp[s:mid], s
                y, hi = (fp[mid:e], mid) if across else (x, s)
                span = Forest(e - s)
                for i, j in key_pairs(x, y, int(key[s] % len(segs)), distance, masks):
                    i, j = i + (lo - s), j + (hi - s)
                    span.add(*((i, j) if across else (i[i < j], j[i < j])))
                i, j = span.links()
                if len(i):
                    a.append(rep[s + i])
                    b.append(rep[s + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    units = blocked(keyed, "key", "fp", BLOCK_ROWS)
    return bounded(units.repartition("key", "blk").sortWithinPartitions("key", "blk", "side"), compare, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; see the module for the defined cases."""
    return components_of(cut(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp"), distance)


def components_of(fps: DataFrame, distance: int) -> DataFrame:
    """(id, fp, component_id) of fingerprints (id, fp); a component of null ids alone has a null one."""
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.col("fp")), "simhash-class")
    # linked by fingerprint, so that one which only null ids have still joins its neighbours
    comps = components(cut(links(classes.select("fp", "rep"), distance), "simhash-link"), "simhash-cc")
    joined = cut(classes.join(comps, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("c")), "simhash-placed")
    least = joined.groupBy(F.col("c").alias("_c")).agg(F.min("least").alias("component_id"))
    placed = joined.join(least, F.col("c") == F.col("_c")).select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(placed, F.col("fp") == F.col("_fp")).select("id", "fp", "component_id")


def shingles(text: str | None, shingle: int = 5) -> set[bytes]:
    """The word shingles of a text, as :func:`fingerprint` cuts them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def alike(x: set[bytes], y: set[bytes]) -> bool:
    """Whether the Jaccard similarity is NEAR or more."""
    if min(len(x), len(y)) * NEAR[1] < max(len(x), len(y)) * NEAR[0]:
        return False
    both = len(x & y)
    return both * NEAR[1] >= (len(x) + len(y) - both) * NEAR[0]


def hashes(found: set[bytes]) -> np.ndarray:
    """The hashes of a set of shingles, in order."""
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x) for x in found), np.uint64, len(found)))


def band_keys(h: np.ndarray) -> list[int]:
    """The keys of a set of hashes, one for each band of ROWS least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1024):
        x = h[k : k + 1024, None] * _ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(raw)]


def _sketches(texts: DataFrame) -> DataFrame:
    """texts (id, t, text) -> (id, t, s, fp, keys): hash of the set of shingles, its SimHash fingerprint, keys of its bands."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [hashes(shingles(x)) for x in batch.column(2).to_pylist()]
        s, fp = (np.array([f(h) for h in made], np.uint64).view(np.int64) for f in (lambda h: xxhash.xxh64_intdigest(h.tobytes()), majority))
        keys = np.array([band_keys(h) for h in made], np.uint64).view(np.int64).reshape(-1)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * BANDS, pa.int32()), pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array(fp), keys], ["id", "t", "s", "fp", "keys"])

    return arrow(texts, each, "id long, t long, s long, fp long, keys array<long>", 256)


def _near_pairs(classes: DataFrame) -> DataFrame:
    """classes (fp, rep, t) -> (a, ta, b, tb): links that span the classes whose fingerprints differ in NEAR_BITS at most."""
    fps = cut(classes.groupBy("fp").agg(F.min(F.struct("rep", "t")).alias("f")).select("fp", "f.*"), "near-fp")
    first = fps.toDF("_fp", "b", "tb")
    equal = classes.join(grown(first), F.col("fp") == F.col("_fp")).where(F.struct("b", "tb") < F.struct("rep", "t"))
    # linked by fingerprint, as an id alone doesn't name a text
    close = cut(links(fps.select("fp", F.col("fp").alias("rep")), NEAR_BITS).distinct().toDF("x", "y"), "near-close")
    close = close.join(grown(fps.toDF("_x", "a", "ta")), F.col("x") == F.col("_x")).join(grown(first), F.col("y") == F.col("_fp"))
    return equal.select(F.col("rep").alias("a"), F.col("t").alias("ta"), "b", "tb").unionAll(close.select("a", "ta", "b", "tb"))


def _confirmed(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, text_a, text_b) -> (a, b) of those that are alike."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = [alike(shingles(u), shingles(v)) for u, v in zip(x, y, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return arrow(pairs.select("a", "b", "text_a", "text_b"), each, "a long, b long", 256)


def _compared(units: DataFrame) -> DataFrame:
    """units (grp, blk, side, rep, comp, text) -> (a, b): confirmed links between the components of each unit."""

    def compare(batches):
        for t, starts in key_groups(batches, ["grp", "blk"], 256):
            side, rep, comp = (t[c].to_numpy() for c in ("side", "rep", "comp"))
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                mid = s + int(np.searchsorted(side[s:e], 1))
                if mid == s or e - s < 2:
                    continue
                sets = [shingles(x) for x in t["text"].slice(s, e - s).to_pylist()]
                root = {c: c for c in comp[s:e].tolist()}

                def find(x, root=root):
                    while root[x] != x:
                        x = root[x]
                    return x

                for i in range(mid - s):
                    for j in range(mid - s, e - s) if mid < e else range(i + 1, e - s):
                        x, y = find(comp[s + i]), find(comp[s + j])
                        if x != y and alike(sets[i], sets[j]):
                            root[max(x, y)] = min(x, y)
                            a.append(int(rep[s + i]))
                            b.append(int(rep[s + j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return bounded(units.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "side"), compare, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row with an id: components of texts whose shingles are alike.

    Candidates are near by SimHash, or share a band of least hashes: each text is held against the commonest
    least member of its bands. Every candidate is confirmed. Bands that still hold more than one component are
    then compared in full, in blocks.
    """
    texts = id_text(docs, id_col, text_col).where("id IS NOT NULL").select("id", F.xxhash64("text").alias("t"), "text")
    rows = cut(_sketches(texts), "near-sketch")
    classes = cut(rows.groupBy("s").agg(F.min(F.struct("id", "t", "fp", "keys")).alias("m")).select("s", "m.*"), "near-class")
    keyed = classes.select(F.col("id").alias("rep"), "t", F.explode("keys").alias("key"))
    first = F.min(F.struct("rep", "t")).alias("first")
    shared = keyed.groupBy(F.col("key").alias("_k")).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(keyed.join(grown(shared), F.col("key") == F.col("_k")).select("key", "rep", "t", "first"), "near-member")
    banded = members.where(F.col("first") < F.struct("rep", "t")).groupBy("rep", "t").agg(F.mode("first").alias("f")).select("rep", "t", "f.*").toDF("a", "ta", "b", "tb")
    near = _near_pairs(classes.select("fp", F.col("id").alias("rep"), "t"))
    edges = cut(near.unionAll(banded).distinct(), "near-edge")
    nodes = members.select("rep", "t").unionAll(edges.select("a", "ta")).unionAll(edges.select("b", "tb")).distinct().toDF("_i", "_t")
    own = cut(
        texts.join(grown(nodes), (F.col("id") == F.col("_i")) & (F.col("t") == F.col("_t"))).select("id", "t", "text").dropDuplicates(["id", "t"]), "near-text"
    )
    one, other = own.toDF("_ia", "_ta", "text_a"), own.toDF("_ib", "_tb", "text_b")
    pairs = edges.join(grown(one), (F.col("a") == F.col("_ia")) & (F.col("ta") == F.col("_ta")))
    pairs = pairs.join(grown(other), (F.col("b") == F.col("_ib")) & (F.col("tb") == F.col("_tb")))
    sure = cut(_confirmed(pairs), "near-link")
    comps = components(sure, "near-cc").toDF("_n", "_c")
    placed = members.join(comps, F.col("rep") == F.col("_n"), "left").select("key", "rep", "t", F.coalesce("_c", "rep").alias("comp"))
    placed = cut(placed, "near-placed")
    open_ = (
        placed.groupBy(F.col("key").alias("_k"))
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.expr("sum(xxhash64(rep, t) % 1000000007)").alias("x"), F.expr("sum(xxhash64(t, rep) % 1000000007)").alias("y"))
        .where("lo < hi")
        .groupBy("n", "x", "y")  # bands of the same members
        .agg(F.min("_k").alias("_k"))
        .select("_k")
    )
    left = cut(placed.join(open_, F.col("key") == F.col("_k")).select(F.col("key").alias("grp"), "rep", "t", "comp"), "near-open")
    units = blocked(left, "grp", "rep", COMPARE_ROWS)
    units = units.join(grown(own.toDF("_i", "_t", "text")), (F.col("rep") == F.col("_i")) & (F.col("t") == F.col("_t")))
    more = cut(_compared(units.select("grp", "blk", "side", "rep", "comp", "text")), "near-more")
    comps = components(sure.unionAll(more), "near-all").toDF("_n", "_c")
    of = classes.select(F.col("s").alias("_s"), F.col("id").alias("rep")).join(comps, F.col("rep") == F.col("_n"), "left")
    of = cut(of.select("_s", F.coalesce("_c", "rep").alias("component_id")), "near-of")
    return rows.join(grown(of), F.col("s") == F.col("_s")).select("id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep of each component of :func:`jaccard_components` the row with the smallest id; rows with a null id stay.

    Of repeated rows with that same id all stay: they are one document.
    """
    keep = jaccard_components(docs, id_col, text_col).where(F.col("id") == F.col("component_id"))
    keep = cut(keep.select(F.col("id").alias("_keep")).distinct(), "near-keep")
    rows, own = by_position(docs, id_col)
    out = rows.join(grown(keep), F.col(own).cast("long") == F.col("_keep"), "left").where(F.col(own).isNull() | F.col("_keep").isNotNull())
    return own_columns(out, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

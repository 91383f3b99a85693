"""Byte-level BPE by Spark's higher-order functions.

The merges run in Spark SQL: a word is an array of its bytes' ids, and a fold joins the leftmost
neighbours of the lowest rank until no neighbours have one. The rank map is a literal of the plan: the
rank of every pair of ids whose bytes together have one, as an array of small maps addressed by
remainder, since looking a key up in one Spark map reads all of it. Ids are decoded by a literal
array of binary pieces, which are concatenated (Spark joins arrays of strings in one step, and its
strings are bytes; nothing is read as characters on the way).

Each match of the split pattern is a word. Of the corpus's distinct words, counted over all texts, the
``HEAD`` commonest at most (all of a count, or none) are folded once, and their ids become a second
literal of the plan, of bounded size; any other word is folded where it stands. That changes where the
work is done, not its result. Nothing but word counts is shuffled, and no row is larger than its document's.

Java's regular expressions split the texts. Its ``\\s`` is written out, and letters and digits of newer
Unicode versions, which the ``tiktoken`` library knows and Java doesn't, are added for texts that leave
the ranges in which all versions agree.

Defined cases: a null or empty text has no ids; repeated rows give equal values; a null id is carried;
an empty table gives no rows; other columns are ignored; a byte without a rank, or a piece that its
own bytes' merges don't give, is an error, and so is a word of 2 ** 27 bytes. The time of one word is
quadratic in its length (16,000 letters: some seconds); that of a text is linear in its words.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import cut, discard, id_text, table

#: Distinct words that are folded once and looked up, at most.
HEAD = 1 << 18
#: Maps in which they lie, and those of the pairs; odd, so that both ids of a pair count.
HEAD_BUCKETS, BUCKETS = (1 << 18) - 1, (1 << 17) - 1
#: White space in Unicode.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Where letters, digits and white space are the same in all Unicode versions from 6 on: the first range, and the rest.
SETTLED = r"\x{0}-\x{51F}", r"\x{2010}-\x{206F}\x{3000}-\x{30FF}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def check_ranks(ranks: dict[bytes, int]) -> None:
    """Every byte has a rank, and every piece comes out of its own bytes, so no word needs a look-up as a whole."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a single byte has no rank")
    if max(ranks.values()) >= NONE:
        raise ValueError("a rank is too large")
    for piece, rank in ranks.items():
        now = [piece[k : k + 1] for k in range(len(piece))]
        while len(now) > 1:
            low, k = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)))
            if low == 1 << 60:
                raise ValueError(f"piece {rank} isn't reached by merges")
            now[k : k + 2] = [now[k] + now[k + 1]]


def pairs(ranks: dict[bytes, int]) -> pd.DataFrame:
    """(k, v): the two ids in one number, and rank, of every pair that merges."""
    found = [
        ((a << 32) + b, rank)
        for piece, rank in ranks.items()
        for k in range(1, len(piece))
        if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None
    ]
    return pd.DataFrame(found, columns=["k", "v"])


def map_literal(entries: DataFrame, bucket: Column, buckets: int) -> Column:
    """array<map<k, v>>: the entries (k, v) by bucket, as a literal that a subquery makes once."""
    own = entries.groupBy(bucket.cast("long").alias("_b")).agg(F.collect_list(F.struct("k", "v")).alias("e"))
    every = entries.sparkSession.range(buckets).join(own, F.col("id") == F.col("_b"), "left")
    # a row a bucket, whatever the input
    listed = F.sort_array(F.collect_list(F.struct("id", "e")))
    return every.agg(F.transform(listed, lambda r: F.map_from_entries(r["e"])).alias("t")).scalar()


def piece_literal(spark: SparkSession, pieces: dict[int, bytes]) -> Column:
    """array<string>: the bytes of every id, in order; ids without any are null."""
    every = [pieces.get(k) for k in range(max(pieces, default=-1) + 1)]
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(every)), "v": every}), "k long, v binary")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda r: r["v"].cast("string")).alias("t")).scalar()


def rank_of(table: Column, a: Column, b: Column) -> Column:
    """The rank of a pair of ids, null if it has none or one is null."""
    return _let(a.cast("bigint") * (1 << 32) + b, lambda key: F.get(table, (key % BUCKETS).cast("int"))[key])


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: the end of a fold over nothing, which copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


#: A place of the fold: the rank of the id with its right neighbour, its first byte's place, the id.
ID_BITS, PLACE_BITS = 18, 27
#: The rank of what has none.
NONE = (1 << ID_BITS) - 1


def _packed(rank: Column, rest: Column) -> Column:
    return F.shiftleft(F.coalesce(rank, F.lit(NONE)).cast("bigint"), ID_BITS + PLACE_BITS) + rest


def _id(x: Column) -> Column:
    return x.bitwiseAND(F.lit(NONE))


def _rest(x: Column) -> Column:
    """The place and the id, without the rank."""
    return x.bitwiseAND(F.lit((1 << ID_BITS + PLACE_BITS) - 1))


def merge_once(table: Column, state: Column) -> Column:
    """Join the leftmost pair of neighbours of the lowest rank; as it is if no pair has a rank.

    state: array<bigint>, a number for each id; the least is the pair to join, as ranks come first in
    it and then places. The rank of a pair is the id that it becomes, and a merge changes the ranks of
    two pairs only.
    """

    def joined(low: Column, k: Column) -> Column:
        new = F.shiftright(low, ID_BITS + PLACE_BITS)
        own = _packed(rank_of(table, new, _id(F.get(state, k + 1))), _rest(low) - _id(low) + new)
        tail = F.slice(state, k + 2, F.lit(1 << 30))
        # flatten() joins arrays several times as fast as concat() here
        return F.when(k == 1, F.flatten(F.array(F.array(own), tail))).otherwise(
            _let(
                F.get(state, k - 2),
                lambda left: F.flatten(
                    F.array(F.slice(state, F.lit(1), k - 2), F.array(_packed(rank_of(table, _id(left), new), _rest(left)), own), tail)
                ),
            )
        )

    def at(low: Column) -> Column:
        return F.when(low >= NONE << ID_BITS + PLACE_BITS, state).otherwise(
            _let(F.array_position(state, low).cast("int"), lambda k: joined(low, k))
        )

    return _let(F.array_min(state), at)


def encode_word(table: Column, first: Column) -> Column:
    """array<int>: the ids of a word, from the ids of its bytes."""

    def fold(first: Column) -> Column:
        def place(a: Column, k: Column) -> Column:
            return _packed(rank_of(table, a, F.get(first, k + 1)), F.shiftleft(k.cast("bigint"), ID_BITS) + a)

        return F.aggregate(
            F.slice(first, F.lit(2), F.lit(1 << 30)),  # a merge less than bytes at most
            F.transform(first, place),
            lambda state, _: merge_once(table, state),
            lambda state: F.transform(state, lambda x: _id(x).cast("int")),
        )

    return _let(first, fold)


def decode_ids(pieces: Column, ids: Column) -> Column:
    """The bytes of ids, as a string: their pieces, concatenated."""
    return F.array_join(F.transform(ids, lambda k: F.get(pieces, k)), "")


def coded(pieces: Column, numbers: Column, ids: Column) -> Column:
    """(raw, text): ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
    return F.struct(decode_ids(numbers, ids).alias("raw"), decode_ids(pieces, ids).alias("text"))


def from_raw(raw: Column) -> Column:
    """array<bigint>: the ids of little-endian unsigned 32-bit integers."""

    def one(i: Column) -> Column:
        four = [F.substring(raw, i * 4 + k, F.lit(1)) for k in (4, 3, 2, 1)]
        return F.conv(F.hex(F.concat(*four)), 16, 10).cast("bigint")

    n = (F.octet_length(raw) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


# ------------------------------------------------------------------ words


def _unknown(spark: SparkSession, kind: str, like: str) -> str:
    """Ranges of the characters that ``tiktoken`` takes for ``\\p{kind}`` and this JVM doesn't, as in a class."""
    import public_tokenizers
    import regex
    import tiktoken

    every = "".join(chr(k) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000)
    wanted = "".join(regex.findall(rf"\p{{{kind}}}", every))
    left = spark._jvm.java.util.regex.Pattern.compile(rf"\p{{{kind}}}+").matcher(wanted).replaceAll("")
    # one piece with a character of the kind shows in a merge across the two
    ranks = {bytes([b]): b for b in range(256)} | {like.encode() + bytes([b]): 128 + b for b in range(128, 256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out: list[list[int]] = []
    for k in sorted(map(ord, left)):
        if probe.encode_ordinary(like + chr(k))[0] > 255:
            if out and out[-1][1] == k - 1:
                out[-1][1] = k
            else:
                out.append([k, k])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def java_pattern(pattern: str, letters: str = "", digits: str = "") -> str:
    """The split pattern for Java, with more letters and digits."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}{letters}{digits}]")
    for kind, more in ((r"\p{L}+", letters), (r"\p{N}+", digits)):
        out = out.replace(" ?" + kind, f" ?[{kind[:-1]}{more}]+")
    return out.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def settled(text: Column) -> Column:
    """Whether all characters lie in SETTLED. Java tests the ranges of a class one by one, so most texts meet the first alone."""
    first, rest = SETTLED
    ascii_ = F.octet_length(text) == F.char_length(text)
    return ascii_ | text.rlike(rf"\A[{first}]*\z") | ~text.rlike(rf"[\x{{520}}-\x{{10FFFF}}&&[^{rest}]]")


def words(spark: SparkSession, text: Column) -> Column:
    """array<string>: the matches of the split pattern."""
    import public_tokenizers

    plain = java_pattern(public_tokenizers.PATTERN)
    full = java_pattern(public_tokenizers.PATTERN, _unknown(spark, "L", "a"), _unknown(spark, "N", "1"))
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.when(settled(text), found(plain)).otherwise(found(full))


def first_ids(ranks: dict[bytes, int], word: Column) -> Column:
    """array<int>: the ids of a word's bytes."""
    of = F.lit([ranks[bytes([b])] for b in range(256)])
    each = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
    ids = F.transform(each, lambda c: F.get(of, F.ascii(c)))
    too_long = F.raise_error("a word of 2 ** 27 bytes or more").cast("array<int>")
    return F.when(F.octet_length(word) >= 1 << PLACE_BITS, too_long).otherwise(ids)


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(HEAD_BUCKETS))


def head(texts: DataFrame, ranks: dict[bytes, int], merges: Column, pieces: Column, numbers: Column) -> Column:
    """The literal of the commonest words, coded."""
    spark = texts.sparkSession
    counts = cut(
        texts.select(F.explode(words(spark, F.col("text"))).alias("k"))
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("k", F.floor(F.log2("n") * 8).cast("int").alias("level")),
        "bpe-count",
    )
    # some hundred levels, whatever the input
    levels = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, math.inf
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > HEAD:
            break
        least = level
    common = counts.where(F.col("level") >= F.lit(float(least))).select("k", merges.alias("m"))
    ids = _let(F.struct("k", "m"), lambda x: encode_word(x["m"], first_ids(ranks, x["k"])))
    folded = common.select("k", ids.alias("ids"), pieces.alias("p"), numbers.alias("q"))
    folded = cut(folded.select("k", _let(F.struct("ids", "p", "q"), lambda x: coded(x["p"], x["q"], x["ids"])).alias("v")), "bpe-head")
    discard(counts)
    return map_literal(folded, _bucket(F.col("k")), HEAD_BUCKETS)


def encode(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``keep_ids`` ids and decoded bytes too."""
    ranks = read_ranks(ranks_path or default_ranks())
    check_ranks(ranks)
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    table_of = spark.createDataFrame(pairs(ranks), "k long, v int")
    merges = map_literal(table_of, F.col("k") % BUCKETS, BUCKETS)
    by_id = {rank: piece for piece, rank in ranks.items()}
    pieces, numbers = piece_literal(spark, by_id), piece_literal(spark, {k: k.to_bytes(4, "little") for k in by_id})
    with_literals = rows.select(
        "id",
        words(spark, F.col("text")).alias("words"),
        head(rows, ranks, merges, pieces, numbers).alias("head"),
        merges.alias("merges"),
        pieces.alias("pieces"),
        numbers.alias("numbers"),
    )

    def document(x: Column) -> Column:
        def one(w: Column) -> Column:
            own = _let(encode_word(x["merges"], first_ids(ranks, w)), lambda ids: coded(x["pieces"], x["numbers"], ids))
            return F.coalesce(F.get(x["head"], _bucket(w))[w], own)

        def joined(found: Column) -> Column:
            return F.struct(*[F.array_join(found[c], "").cast("binary").alias(c) for c in ("raw", "text")])

        return _let(F.transform(x["words"], one), joined)

    # one expression, so that Spark puts the literals into it and no row carries them
    made = with_literals.select("id", _let(F.struct("words", "head", "merges", "pieces", "numbers"), document).alias("d"))
    return made.select(
        "id",
        (F.octet_length("d.raw") / 4).cast("long").alias("n_tokens"),
        F.sha2("d.raw", 256).alias("ids_sha256"),
        F.sha2("d.text", 256).alias("decoded_sha256"),
        *([from_raw(F.col("d.raw")).alias("ids"), F.col("d.text").alias("decoded")] if keep_ids else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

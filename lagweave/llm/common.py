"""Shared pieces of the training-data operators: pinned tables, skew-safe lookups, text helpers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.session import hadoop_path, pin, unpin  # noqa: F401 - the operators take them from here

#: White space that separates words, as a Java / Python regular expression.
WS = "[ \\t-\\r]+"
#: A lookup table of at most this many (narrow) rows is broadcast; above, see lookup_join.
BROADCAST_ROWS = 100_000
#: Its Parquet may hold so many bytes besides.
BROADCAST_BYTES = 16 << 20
#: Heaviest keys that lookup_join and name_keys treat apart from the rest.
HEAVY_KEYS = 512
#: Bits that lookup_wide spends on a key of its table, and 64-bit words of them at most.
BITS_A_KEY, MOST_WORDS = 32, 1 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df may be broadcast: few rows and, where it is known, few bytes."""
    if getattr(df, "_pinned_path", None):
        fs, p = hadoop_path(df)
        if fs.getContentSummary(p).getLength() > BROADCAST_BYTES:
            return False
    return df.count() <= rows


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str | None = None,
    how: str = "left",
    bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """left ⋈ table, where table is pinned and has one row per key (null keys match null keys).

    A table within `bound` rows and BROADCAST_BYTES is broadcast. Above, its HEAVY_KEYS heaviest keys (by `weight`) are
    broadcast and the rows of left that match none of them are shuffled to the rest of the table, so
    no hot key of left is ever gathered in one task. how: left, inner, left_semi or left_anti.
    """

    def joined(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        renamed = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
        return a.join(renamed, cond, kind).drop(*[f"_k_{k}" for k in keys])

    if is_small(table, bound):
        return joined(left, F.broadcast(table), how)
    if weight is None:
        return joined(left, table, how)
    heavy = pin(table.orderBy(F.col(weight).desc(), *keys).limit(HEAVY_KEYS), "heavy")
    hot_keys = F.broadcast(heavy.select(*keys))
    cold = joined(left, hot_keys, "left_anti")
    rest = joined(table, hot_keys, "left_anti")
    if how == "left_anti":
        return joined(cold, rest, how)
    hot = joined(left, F.broadcast(heavy), "inner" if how == "left" else how)
    return union_all(hot, joined(cold, rest, how))


def _key_bits(table: DataFrame, key: str, words: int) -> DataFrame:
    """One row: an array of `words` longs, in which the bit that a key hashes to is set for every key of table."""

    def fill(batches):
        out = np.zeros(words, np.int64)
        for batch in batches:
            out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out])], names=["_bits"])

    hashes = table.select(F.xxhash64(key).alias("h"))
    word, bit = F.pmod(F.shiftrightunsigned("h", 6), F.lit(words)).alias("word"), F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits")
    return hashes.groupBy(word).agg(bit).coalesce(1).mapInArrow(fill, "_bits array<long>")


def lookup_wide(left: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """left ⋈ table on `key` (null keys match null keys) where rows of left are wide, such as texts, and few have a match; table is pinned.

    A small table is broadcast. Of a larger one, an array of bits of its keys' hashes is: rows of left whose bit is not set have no
    match and are never shuffled; the others (the matches, and a few more) are joined exactly. left is read twice for left_anti.
    how: inner, left_semi or left_anti.
    """
    renamed = table.withColumnRenamed(key, "_key")
    exact = left[key].eqNullSafe(renamed["_key"])
    if is_small(table, BROADCAST_ROWS):
        found = left.join(F.broadcast(renamed), exact, how)
        return found.drop(renamed["_key"]) if how == "inner" else found
    words = min(table.count() * BITS_A_KEY // 64 + 1, MOST_WORDS)
    bits = F.broadcast(pin(_key_bits(table, key, words), "bits"))
    h = F.xxhash64(left[key])
    word = F.get(bits["_bits"], F.pmod(F.shiftrightunsigned(h, 6), F.lit(words)).cast("int"))
    is_set = F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
    maybe = left.join(bits, is_set, "left_semi")
    found = maybe.join(renamed, maybe[key].eqNullSafe(renamed["_key"]), how)
    if how == "inner":
        return found.drop(renamed["_key"])
    return union_all(left.join(bits, is_set, "left_anti"), found) if how == "left_anti" else found


def hashed(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 (no padding is needed for 20 bytes) of a SHA-1 given in hex."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), digits, letters)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

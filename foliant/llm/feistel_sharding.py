"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame operations only.

Rows are numbered 0..N-1 in order of (doc_id, size, crc32), without a single-task sort: ids, sizes and checksums are
range-partitioned and sorted in place, written once, and each partition's count gives the base of its numbers (one
row for each partition goes to the driver). A row number x = l * b + r, with l below a = ceil(sqrt N) and r below
b = ceil(N / a), passes an even number of rounds that add a keyed hash of one half to the other, modulo a or b: a
permutation of 0..a*b-1. a * b - N is below a, and a value of N or more is passed again until it is below N, so the
whole is a permutation p of 0..N-1. shard = p mod shards and slot = p div shards: counts differ by one at most,
slots have no gaps, and anyone with N, the seed and a row number computes both; unpermute() gives the row back.

Null or empty text: 8 bytes and crc 0. Null doc_id: numbered first. Equal rows: each has its own number; which of
them has which can't be told apart. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS, SEED = 8, 20260101


def halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1 if n > 1 else 1)
    return a, max(1, -(-n // a))


def _round(x: Column, n: int, seed: int) -> Column:
    """One pass over 0..a*b-1, as a Column; each round's halves are two fields of a struct, so no term is repeated."""
    a, b = halves(n)

    def step(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.pmod(k, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(left + F.pmod(F.xxhash64(right, k, F.lit(seed)), F.lit(a)), F.lit(a))).otherwise(left).alias("l"),
            F.when(even, right).otherwise(F.pmod(right + F.pmod(F.xxhash64(left, k, F.lit(seed)), F.lit(b)), F.lit(b))).alias("r"),
        )

    start = F.struct(F.floor(x / F.lit(float(b))).cast("long").alias("l"), F.lit(0).cast("long").alias("r")) if n >= 1 << 52 else None
    start = start or F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    rounds = F.array(*[F.lit(k).cast("long") for k in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """p(x) for 0 <= x < n. Each value of n or more is met once at most on a walk, so a walk of as many passes as there
    are such values always ends; of more than 64 of them, a walk of 64 would need 64 hits among a share of 1 / 64 at
    most. Were one longer, the query would fail rather than return a wrong number."""
    a, b = halves(n)
    walk = min(a * b - n, 64)
    once = _round(x, n, seed)
    if not walk:
        return once
    passes = F.array(*[F.lit(k) for k in range(walk)])
    p = F.aggregate(passes, once, lambda v, _: F.when(v < F.lit(n), v).otherwise(_round(v, n, seed)))
    return F.when(p < F.lit(n), p).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with row_number (0..N-1 in the order of the columns), and N."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(parts.withColumn("row_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("row_at", 33)
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    bases = list(zip([p for p, _ in counts], [0, *accumulate(n for _, n in counts)], strict=False))
    base = spark.createDataFrame(bases, "row_part long, row_base long")
    numbered = kept.withColumn("row_part", part).join(base, "row_part")
    return numbered.withColumn("row_number", F.col("row_base") + F.col("row_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("row_part", "row_base", "row_at"), total


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, position."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows, n = number_rows(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), ["doc_id", "size", "text_crc32"])
    placed = rows.withColumn("position", permute(F.col("row_number"), max(n, 1), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        ((F.col("position") - F.pmod("position", F.lit(shards))) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )

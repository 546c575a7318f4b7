"""Best-fit packing: token pieces into sequences of fixed length, by bounded-space online best fit.

A document is its ids and an end id. One of more than seq_len ids is cut into pieces of seq_len; only its first piece
may be shorter. A piece of seq_len is a sequence of its own and is not shuffled. The others are dealt by a hash of
their key into groups of about GROUP_PIECES, and each group is packed by itself: pieces arrive longest first, at most
OPEN_BINS bins are open, a bitset has a bit for each free space that an open bin has, and the lowest set bit from a
piece's length upward is the fullest bin that takes it. If none does and no more may be open, the fullest closes. A
group is a fixed number of rows of a few dozen bytes, whatever the table's size, and its result depends on nothing
but its rows, so a lost executor's groups are packed again alike.

Null or empty text: the end id alone. Null doc_id: kept, as null. Repeated rows: packed each by itself. Empty table:
no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import encoder

GROUP_PIECES, OPEN_BINS = 6000, 4096
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: list[int], capacity: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given."""
    bins, offsets, free_bits, opened, made = [], [], 0, 0, 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(free: int) -> int:
        nonlocal free_bits, opened
        b = stacks[free].pop()
        opened -= 1
        if not stacks[free]:
            free_bits ^= 1 << free
        return b

    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} ids does not fit {capacity}")
        fitting = free_bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = take(free)
        else:
            if opened >= open_bins:
                take((free_bits & -free_bits).bit_length() - 1)
            b, free, made = made, capacity, made + 1
        bins.append(b)
        offsets.append(capacity - free)
        if free > n:
            if not stacks[free - n]:
                free_bits |= 1 << (free - n)
            stacks[free - n].append(b)
            opened += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, piece_key (unique), and ids (little-endian unsigned 32-bit) if asked."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, piece_key long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = encoder(tokenizer).encode, TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                first = n % seq_len or seq_len
                for k, start in enumerate([0, *range(first, n, seq_len)]):
                    part = ids[4 * start : 4 * (first if k == 0 else start + seq_len)]
                    row = (doc_id, k, start, len(part) // 4, zlib.crc32(part), key, bytes(part) if with_ids else None)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    key += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(parts: DataFrame, seq_len: int = 2048, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """A place for each row of a written table of pieces()."""
    loose = parts.filter(F.col("length") < seq_len)
    groups = max(1, math.ceil(loose.count() / group_pieces))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece_key"], ascending=[False, True])
        bins, offsets = best_fit(pdf["length"].tolist(), seq_len, open_bins)
        pdf["sequence_id"] = (int(key[0]) << 32) + np.array(bins, "int64")
        pdf["offset"] = np.array(offsets, "int64")
        return pdf[[c.split()[0] for c in PLACED.split(", ")]]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = (
        loose.select(*columns, "piece_key", F.pmod(F.xxhash64("piece_key"), F.lit(groups)).alias("pack_group"))
        .groupBy("pack_group")
        .applyInPandas(run, PLACED)
    )
    full = parts.filter(F.col("length") == seq_len).select(*columns, (-1 - F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    return pack(written(pieces(docs, tokenizer, seq_len, end_id), "pieces"), seq_len)


def sequences(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit), lengths (of the
    pieces, in order). A sequence gathers at most seq_len ids."""
    parts = written(pieces(docs, tokenizer, seq_len, end_id, with_ids=True), "pieces")
    loose = parts.filter(F.col("length") < seq_len)
    groups = max(1, math.ceil(loose.count() / GROUP_PIECES))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "piece_key"], ascending=[False, True])
        bins, _ = best_fit(pdf["length"].tolist(), seq_len)
        out: dict[int, list[bytes]] = {}
        for b, ids in zip(bins, pdf["ids"], strict=True):
            out.setdefault(b, []).append(bytes(ids))
        base = int(key[0]) << 32
        return pd.DataFrame({"sequence_id": [base + b for b in out], "n_tokens": [sum(map(len, v)) // 4 for v in out.values()], "ids": [b"".join(v) for v in out.values()], "lengths": [[len(x) // 4 for x in v] for v in out.values()]})

    schema = "sequence_id long, n_tokens long, ids binary, lengths array<long>"
    full = parts.filter(F.col("length") == seq_len).select((-1 - F.col("piece_key")).alias("sequence_id"), F.col("length").alias("n_tokens"), "ids", F.array("length").alias("lengths"))
    dealt = loose.select("piece_key", "length", "ids", F.pmod(F.xxhash64("piece_key"), F.lit(groups)).alias("pack_group"))
    return dealt.groupBy("pack_group").applyInPandas(run, schema).unionByName(full)

"""Lempel-Ziv phrase fingerprints: the phrases that an LZ78 parse of a text enters into its dictionary are hashed, and
a one-permutation minimum-hash signature of BINS bins stands for the set. Likeness is the share of non-empty bins in
which two signatures agree: an estimate of the Jaccard similarity of the phrase sets, high for texts that would
compress well together.

A text whose end is replaced shares its parse up to the cut, so the edited text is parsed from the last phrase before
the cut on. Phrase dictionaries are closed under prefixes, so the longest known phrase is found by stepping from the
last phrase's length instead of from one byte.

The next document in descending doc_id is found without a global sort in one task: ids are cut into buckets at
quantiles (and an id of many rows, null among them, by a hash of the text), a bucket is sorted, and the first row of each bucket is also dealt to the bucket before it, behind its
rows. One document is held besides the one read. Null or empty text: no phrases, an all-empty signature; two such are
alike (1), one such and another are not (0). Equal doc_ids: in order of a hash of the text. Null doc_id: last. One
document alone is its own next. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices

BINS = 128
LOWEST = -(1 << 63)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def parse(data: bytes, start: int = 0, known: set[bytes] | None = None) -> list[bytes]:
    """The phrases that data, from start on, adds to a dictionary, in order; known is extended. The dictionary is
    closed under prefixes, so the search for the longest known phrase may begin at any length: at the mean so far."""
    known = set() if known is None else known
    out, n, begun, size = [], len(data), start, 4
    add, put = known.add, out.append
    while start < n:
        phrase = data[start : start + size]
        if phrase in known:
            end = start + size
            while phrase in known:
                if end >= n:
                    return out
                end += 1
                phrase = data[start:end]
        else:
            shorter = phrase[:-1]
            while shorter and shorter not in known:
                phrase, shorter = shorter, shorter[:-1]
        add(phrase)
        put(phrase)
        start += len(phrase)
        if not len(out) & 63:
            size = max(1, (start - begun) // len(out) + 1)
    return out


def hashes(phrases: list[bytes]) -> np.ndarray:
    """64 bits of each phrase: its checksum, spread by a fixed mix."""
    x = np.fromiter(map(crc32, phrases), np.uint64, len(phrases)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(h: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash in each bin; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint16)
    if len(h):
        h = np.sort(h)
        at = np.searchsorted(h, _EDGES)
        there = (at < len(h)) & (np.concatenate((at[1:], [len(h)])) > at)
        out[there] = 1 + (h[at[there]] & np.uint64(0xFFFF)) % np.uint64(0xFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


class Parsed:
    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.data = self.text.encode()
        self.phrases = parse(self.data)
        self.hashes = hashes(self.phrases)
        self.signature = signature(self.hashes)

    def row(self, following: Parsed) -> tuple:
        n = len(self.text)
        cut = n - n // 3
        head = self.text[:cut].encode()
        edited = head + following.text[: n // 3].encode()
        ends = np.cumsum(np.fromiter(map(len, self.phrases), np.int64, len(self.phrases)))
        shared = int(np.searchsorted(ends, len(head), "right"))
        more = parse(edited, int(ends[shared - 1]) if shared else 0, set(self.phrases[:shared]))
        sig = signature(np.concatenate((self.hashes[:shared], hashes(more))))
        return self.doc_id, n, hashlib.sha256(edited).hexdigest(), self.signature.tobytes().hex(), sig.tobytes().hex(), likeness(self.signature, sig), likeness(self.signature, following.signature)


def fingerprint(text: str | None) -> str:
    return Parsed(None, text).signature.tobytes().hex()


def _bounds(ids: list[int]) -> list[tuple[int, int]]:
    """Ascending lower ends (doc_id, inverted tie) of buckets from the quantiles of the ids; an id that is several of
    them holds that many buckets' rows and is cut at even steps of the tie, a hash."""
    out: list[tuple[int, int]] = []
    for i in sorted(set(ids)):
        many = ids.count(i)
        out += [(i, LOWEST + (k << 64) // many) for k in range(many)]
    return out


def _bucket(value, bounds: list[tuple[int, int]]):
    """How many of the ascending bounds are at most value: a binary search of log2 steps."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.struct(F.lit(i).cast("long").alias("rank_id"), F.lit(t).cast("long").alias("m")) for i, t in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) <= value), at + s).otherwise(at))


def fingerprint_documents(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """The columns of OUT for each document: its own fingerprint, that of its edited text, and both likenesses."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rank_id", F.coalesce("doc_id", F.lit(LOWEST)))
    cuts = parts * buckets_per_partition
    bounds = _bounds([int(x) for x in rows.approxQuantile("rank_id", [k / cuts for k in range(1, cuts)], 0.1 / cuts)])
    rows = rows.withColumn("tie", F.xxhash64("text"))
    place = F.struct(F.col("rank_id"), F.bitwise_not("tie").alias("m"))  # ascending, where documents are in descending order
    rows = rows.withColumn("bucket", _bucket(place, bounds))
    # the first row of each bucket: one pair of numbers a bucket
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max(place).alias("top")).collect()}
    order = sorted(tops)
    heads = [(int(tops[b]["rank_id"]), ~int(tops[b]["m"]), order[(k + 1) % len(order)]) for k, b in enumerate(order)]  # behind the next higher bucket; the highest, behind the lowest
    if not heads:
        return spark.createDataFrame([], OUT)
    first = spark.createDataFrame(heads, "rank_id long, tie long, behind int")
    ids = [h[0] for h in heads]
    guests = rows.filter(F.col("rank_id").isin(ids)).join(F.broadcast(first), ["rank_id", "tie"]).select("doc_id", "text", "rank_id", F.col("behind").alias("bucket"), "tie", F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", "rank_id", "bucket", "tie", F.lit(False).alias("guest")).unionByName(guests)
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("rank_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held, held_at = None, None
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text, bucket, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest")), strict=True):
                if guest and held is None:
                    continue  # a further copy of the row behind the bucket
                now = Parsed(doc_id, text)
                if held is not None:
                    assert held_at == bucket, "a bucket without the row behind it"
                    out.append(held.row(now))
                held, held_at = (None, None) if guest else (now, bucket)
            yield pa.RecordBatch.from_pydict({f.name: list(c) for f, c in zip(schema, zip(*out, strict=True), strict=True)} if out else {f.name: [] for f in schema}, schema=schema)

    return dealt.select("doc_id", "text", "bucket", "guest").mapInArrow(run, OUT)

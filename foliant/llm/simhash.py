"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: words of the lower-cased (A-Z) text, joined into shingles with repeats, hashed by XXH64; a bit is set if
more than half of the hashes have it. Fingerprints of more than 64 bits take further words from a fixed mix of the
same hashes. Equal fingerprints are grouped first, so copies cost nothing further.

Distinct fingerprints are dealt by a class into sheets of about BLOCK, and sheets whose classes can hold no link are
never paired. With a radius that is small against the bits, the class is one of radius + 1 groups of bits: of
radius + 1 groups one is equal in any two fingerprints that differ in radius bits, so each fingerprint is dealt once
for each group and meets those alone that share it, a share of one in some thousands. With a wide radius the class is
the population count or, where the caller knows the sizes of the sets and the least ratio of two, the size. Within a
pair of sheets, tiles are skipped whose classes or whose quarters' population counts differ beyond what a link allows
(a bit count of p - q is the least distance), and the rest is compared by numpy exclusive-or and bit counts. The
comparison is exact: no bucket, cap or sample. A class of more than BLOCK is dealt into several sheets, all pairs of
which are compared in tasks of their own. A task keeps only a spanning forest of the links that it finds, so a large
group of near copies yields rows in proportion to its members, not to its pairs; connected components then run as
joins and aggregations over written tables.

Null and empty text: no words, fingerprint zero, linked like any other. Null doc_id: linked like any other, and never
the smallest; a class without any id has none. Very long texts: one text's hashes are held at a time. Ties: equal
fingerprints are one node. Repeated rows: each alike. Empty table: no rows. Extra columns are not read by
near_duplicates(), and kept, whatever their names, by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, shuffle_partitions, slices, written
from .components import Forest, connected_components

BLOCK, TILE = 32768, 256
#: Hashes of the sets of one side of a comparison: 16 MB.
SET_HASHES = 1 << 21
#: Groups of bits are used if each has so many bits at least.
GROUP_BITS = 8
#: Rows at most of a broadcast list of hash buckets (a filter in front of exact joins, which stay right when it fills).
FILTER_BUCKETS = 1 << 19
#: Odd 64-bit constants of the mixes that give the words after the first.
MIXES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles, in order, with repeats; of a text with fewer words, of all of them together."""
    found = text.encode().lower().split() if text else []  # bytes: A-Z only, and white space is x20 and x09 to x0D
    if not found:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    x = (h ^ (h >> np.uint64(31))) * np.uint64(MIXES[k - 1])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIXES[k % 3])
    return x ^ (x >> np.uint64(32))


def majority(h: np.ndarray) -> int:
    """The bits set in more than half of the hashes; zero for none."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, width: int = 1, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (binary, 8 * width bytes: little-endian 64-bit words), and the carried columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, words, seed)
                out.append(np.array([majority(_mixed(h, k)) for k in range(width)], "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(out, pa.binary())], names=["doc_id", *carry, "fp"])

    kinds = dict(docs.dtypes) | {"doc_id": "long"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + ", fp binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in carry if c != "text"], "text").mapInArrow(run, schema)


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each row of 64-bit words."""
    n, width = fps.shape
    if width >= 4:
        return np.bitwise_count(fps).reshape(n, 4, width // 4).sum(2).astype(np.int16)
    return np.bitwise_count(fps.view(np.uint16)).reshape(n, 4, width).sum(2).astype(np.int16)


class Sheet(NamedTuple):
    """Fingerprints in the order of tiles, with the class that each is compared by and its node."""

    fps: np.ndarray  # rows of 64-bit words
    key: np.ndarray
    node: np.ndarray

    @staticmethod
    def of(fps: np.ndarray, key: np.ndarray, node: np.ndarray) -> Sheet:
        order = np.lexsort((*_quarters(fps).T[::-1], key))
        return Sheet(fps[order], key[order], node[order])

    def tiles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowest and highest counts of the quarters, lowest and highest class of each tile."""
        q, at = _quarters(self.fps), np.arange(0, len(self.fps), TILE)
        ends = np.append(at[1:], len(self.fps)) - 1
        return np.minimum.reduceat(q, at, axis=0), np.maximum.reduceat(q, at, axis=0), self.key[at], self.key[ends]


def links_between(a: Sheet, b: Sheet, radius: int, ratio: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b that differ in at most radius bits, the lesser class being at least ratio times
    the greater; of one sheet with itself, i < j."""
    (a_low, a_high, a_least, a_most), (b_low, b_high, b_least, b_most) = a.tiles(), b.tiles()
    width = a.fps.shape[1]
    for i in range(len(a_low)):
        gap = np.maximum(0, np.maximum(b_low - a_high[i], a_low[i] - b_high)).sum(1)
        meets = (gap <= radius) & (b_most >= ratio * a_least[i]) & (a_most[i] >= ratio * b_least)
        rows, row_key = a.fps[i * TILE : (i + 1) * TILE], a.key[i * TILE : (i + 1) * TILE]
        for j in np.flatnonzero(meets).tolist():
            if same and j < i:
                continue
            cols = b.fps[j * TILE : (j + 1) * TILE]
            apart = np.bitwise_count(rows[:, 0, None] ^ cols[None, :, 0])
            for k in range(1, width):
                apart = np.add(apart, np.bitwise_count(rows[:, k, None] ^ cols[None, :, k]), dtype=np.uint16)
            near = apart <= radius
            if same and i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            x, y = np.nonzero(near)
            p, q = row_key[x], b.key[j * TILE : (j + 1) * TILE][y]
            fits = np.minimum(p, q) >= ratio * np.maximum(p, q)
            if fits.any():
                yield x[fits] + i * TILE, y[fits] + j * TILE


def _sheets(counts: dict[int, int], reach: int, block: int) -> list[tuple[int, int, int, int, int]]:
    """Of each class: its first sheet, how many sheets it is dealt into, and the first and last sheet that they are
    compared with (classes at most reach apart). Neighbouring classes share a sheet while they are few."""
    runs: list[list] = []  # classes, rows
    for c in sorted(counts):
        if runs and runs[-1][1] + counts[c] <= block:
            runs[-1][0].append(c)
            runs[-1][1] += counts[c]
        else:
            runs.append([[c], counts[c]])
    many = [max(1, math.ceil(n / block)) for _, n in runs]
    first = [0, *accumulate(many)]
    out, low, high = [], 0, 0
    for r, (classes, _) in enumerate(runs):
        while classes[0] - runs[low][0][-1] > reach:
            low += 1
        high = max(high, r)
        while high + 1 < len(runs) and runs[high + 1][0][0] - classes[-1] <= reach:
            high += 1
        out += [(c, first[r], many[r], first[low], first[high + 1] - 1) for c in classes]
    return out


def near_links(distinct: DataFrame, radius: int, width: int = 1, block: int = BLOCK, least: float | None = None) -> DataFrame:
    """u, v: for every pair of sheets a spanning forest of the links between its fingerprints. distinct: fp, node
    (long), and size where least is given, the least ratio of the sizes of two that are linked."""
    spark, bits = distinct.sparkSession, 64 * width
    assert bits >= radius >= 0
    words = [F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long") for k in range(width)]
    groups = radius + 1
    if least is not None:  # sizes within the ratio are in one class or in two that are neighbours
        key, reach, ratio = F.col("size"), 1, least
        number = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(-math.log(least)))
        dealt = distinct.select("fp", "node", key.cast("long").alias("key"), number.cast("long").alias("class"))
    elif width == 1 and bits // groups >= GROUP_BITS:
        reach, ratio, cuts = 0, 1.0, [bits * k // groups for k in range(groups + 1)]
        same = [F.shiftrightunsigned(F.col("word"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(k << 32) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        dealt = distinct.select("fp", "node", words[0].alias("word")).select("fp", "node", F.explode(F.array(*same)).alias("key")).withColumn("class", F.col("key"))
    else:
        reach, ratio = radius, 1.0
        ones = sum((F.bit_count(w) for w in words), F.lit(0)).cast("long")
        dealt = distinct.select("fp", "node", F.lit(0).cast("long").alias("key"), ones.alias("class"))
    dealt = written(dealt, "dealt")
    # one row for each class there is: of population counts or size classes some hundreds, of bits at most
    # (radius + 1) * 2 ** (64 / (radius + 1)), some ten thousand
    classes = _sheets({r[0]: r[1] for r in dealt.groupBy("class").agg(F.count("*")).collect()}, reach, block)
    if not classes:
        return dealt.select(F.col("node").alias("u"), F.col("node").alias("v"))
    where = F.broadcast(spark.createDataFrame(classes, "class long, first long, many long, low long, high long"))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sheet = Sheet.of(np.frombuffer(b"".join(pdf["fp"]), "<u8").reshape(-1, width), pdf["key"].to_numpy("int64"), pdf["node"].to_numpy("int64"))
        return pd.DataFrame({"number": [key[0]], "low": [pdf["low"].iloc[0]], "high": [pdf["high"].iloc[0]], "fps": [sheet.fps.tobytes()], "keys": [sheet.key.tobytes()], "nodes": [sheet.node.tobytes()]})

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = {n: Sheet(np.frombuffer(f, "<u8").reshape(-1, width), np.frombuffer(k, "int64"), np.frombuffer(v, "int64")) for n, f, k, v in zip(pdf["number"], pdf["fps"], pdf["keys"], pdf["nodes"], strict=True)}
        a, b, same = sheets[key[0]], sheets[key[1]], key[0] == key[1]
        classes, shift = Forest(len(a.node) if same else len(a.node) + len(b.node)), 0 if same else len(a.node)
        for x, y in links_between(a, b, radius, ratio, same):
            classes.add(x, y + shift)
        u, v = classes.stars(a.node if same else np.concatenate((a.node, b.node)))
        return pd.DataFrame({"u": u, "v": v})

    number = F.col("first") + F.pmod(F.xxhash64("node"), F.col("many"))
    sheets = dealt.join(where, "class").select("fp", "node", "key", number.alias("number"), "low", "high").groupBy("number").applyInPandas(gather, "number long, low long, high long, fps binary, keys binary, nodes binary")
    # a sheet is written once, and goes row by row to the cells of the pairs that it is in
    cells = written(sheets, "sheets").select("number", "fps", "keys", "nodes", F.explode(F.sequence("low", "high")).alias("other"))
    cells = cells.select("number", "fps", "keys", "nodes", F.least("number", "other").alias("low"), F.greatest("number", "other").alias("high"))
    # cells are small to move and long to compare, so their partitions are not to be put together by size
    return cells.repartition(shuffle_partitions(spark), "low", "high").groupBy("low", "high").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, width: int = 1, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most radius differing bits."""
    prints = written(fingerprints(docs, words, width, seed), "fingerprints")
    return with_components(prints, radius, width)


def with_components(prints: DataFrame, radius: int, width: int) -> DataFrame:
    """A written table of doc_id, fp (and more) with component_id."""
    # a node stands for a fingerprint, whether it has a doc_id or not
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if width == 1 else F.xxhash64("fp")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", node), "nodes")
    classes = connected_components(written(near_links(nodes.select("fp", "node"), radius, width), "links"))
    classed = written(nodes.join(classes, "node", "left").select("fp", "first_id", F.coalesce("component", "node").alias("component")), "classes")
    least = classed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classed.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp", "left")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hexadecimal digits for each 64-bit word, component_id."""
    return found.select("doc_id", F.lower(F.hex(_big_endian("fp"))).alias("fingerprint"), "component_id")


def _big_endian(name: str):
    """The bytes of each 64-bit word in the other order."""
    word = lambda at: F.concat(*[F.substring(name, at + 7 - k, 1) for k in range(8)])
    return F.concat(word(1), *[F.when(F.length(name) > 8 * k, word(8 * k + 1)).otherwise(F.lit(b"")) for k in range(1, 4)])


def _sets(docs: DataFrame, words: int, seed: int, carry: tuple[str, ...], width: int = 0) -> DataFrame:
    """node (of the set of distinct shingles: a hash of it), the carried columns, and size and fp of the set or, without
    a width, the sorted set itself (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes, sizes, out = [], [], []
            for text in batch.column("text").to_pylist():
                h = np.unique(shingle_hashes(text, words, seed)).astype("<u8", copy=False)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), seed) - (1 << 63))
                sizes.append(len(h))
                out.append(np.array([majority(_mixed(h, k)) for k in range(width)], "<u8").tobytes() if width else h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(batch.column(c) for c in carry), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["node", *carry, "size", "fp" if width else "shingles"])

    kinds = dict(docs.dtypes)
    schema = "node long, " + "".join(f"`{c}` {kinds[c]}, " for c in carry) + "size long, " + ("fp binary" if width else "shingles binary")
    return docs.select(*carry, "text").mapInArrow(run, schema)


def alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the others (sorted distinct hashes, none of them empty) have a Jaccard similarity of least with one."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= least * (len(one) + sizes - both) - 1e-9


def verified_links(members: DataFrame, radius: int, width: int, least: float, block: int = SET_HASHES) -> DataFrame:
    """u, v: a spanning forest, for every pair of blocks, of the links within a component of candidates that have at
    least that Jaccard similarity. members: a written table of component, node, size, fp, shingles, each node once.

    A block is about that many hashes, so what a task holds follows neither a component's members nor their lengths.
    Small components share one; a larger one is dealt into several, and each pair of them is a cell. Every pair within
    the radius is held against the sets, but for those that other links have joined already.
    """
    sizes = members.groupBy("component").agg(F.sum(F.greatest("size", F.lit(1))).alias("n"))
    many = F.ceil(F.col("n") / block).cast("int")
    packs = max(1, math.ceil((members.agg(F.sum("size")).first()[0] or 1) / block))
    dealt = members.join(written(sizes, "sizes"), "component").withColumn("many", many)
    mine = F.pmod(F.xxhash64("node"), F.col("many")).cast("int")
    pack = F.when(F.col("many") == 1, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component"))
    dealt = dealt.select("component", "node", "size", "fp", "shingles", pack.alias("pack"), (F.col("many") > 1).alias("large"), mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
    cells = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, mine = pdf["low"].iloc[0], pdf["high"].iloc[0], pdf["mine"].to_numpy()
        nodes, of = pdf["node"].to_numpy("int64"), pdf["component"].to_numpy("int64")
        fps = np.frombuffer(b"".join(pdf["fp"]), "<u8").reshape(-1, width)
        sets, size, classes = [np.frombuffer(x, "<u8") for x in pdf["shingles"]], pdf["size"].to_numpy("int64"), Forest(len(nodes))
        side = lambda k: Sheet.of(fps[at := np.flatnonzero((mine == k) & (size > 0))], size[at], at)
        first = side(low)
        second = first if low == high else side(high)
        if len(first.node) and len(second.node):
            for x, y in links_between(first, second, radius, least, first is second):
                x, y = first.node[x], second.node[y]
                for i in np.unique(x).tolist():
                    j = y[x == i]
                    j = j[(of[j] == of[i]) & (classes.find(j) != classes.find(np.array([i])))]
                    if len(j):
                        j = j[alike(sets[i], [sets[k] for k in j.tolist()], least)]
                        classes.add(np.full(len(j), i), j)
        u, v = classes.stars(nodes)
        return pd.DataFrame({"u": u, "v": v})

    spread = cells.repartition(shuffle_partitions(members.sparkSession), "large", "pack", "low", "high")
    return spread.groupBy("large", "pack", "low", "high").applyInPandas(compare, "u long, v long")


def _rows_of(keyed: DataFrame, keys: DataFrame, id_name: str, tie: str) -> DataFrame:
    """The rows of keyed whose (doc_id, tie) is in keys (first_id, first_tie): a list of the keys' hash buckets, of at
    most FILTER_BUCKETS numbers, lets the others go where they are read, so that their texts don't move."""
    bucket = lambda a, b: F.pmod(F.xxhash64(F.coalesce(F.col(a), F.lit(0)), F.col(b)), F.lit(FILTER_BUCKETS))
    listed = written(keys.select(bucket("first_id", "first_tie").alias("bucket_of")).distinct(), "buckets")
    near = keyed.join(F.broadcast(listed), bucket(id_name, tie) == F.col("bucket_of"), "left_semi")
    return near.join(keys, F.col(id_name).eqNullSafe(F.col("first_id")) & (F.col(tie) == F.col("first_tie")), "left_semi")


def one_of_each(docs: DataFrame, words: int = 5, width: int = 4, radius: int = 64, least: float = 0.8, seed: int = 42) -> DataFrame:
    """docs without near duplicates: of each class the row with the smallest (doc_id, hash of the text) stays. Classes
    are the components of the links between texts whose sets of distinct shingles have a Jaccard similarity of least.

    Fingerprints only find the candidates. Sets at a Jaccard similarity of 0.8 have a cosine of 2 * 0.8 / 1.8 = 0.889
    at least, an angle of 0.476, and so are about 256 * 0.476 / pi = 39 of 256 bits apart, give or take 6; a radius of
    64 is four deviations from there. Each candidate link is then held against the sets themselves.

    Texts are read where they lie: once for the fingerprints, once for the sets of the candidates, and twice for the
    rows that stay. Only candidates' sets and the few rows that share a hash bucket with a dropped one are shuffled.
    """
    columns = docs.columns
    tie, away = fresh(columns, "row_tie"), fresh(columns, "row_away")
    keyed = docs.withColumn(tie, F.xxhash64(*[c for c in columns if c != "doc_id"]))
    prints = written(_sets(keyed.withColumnRenamed("doc_id", away).select(F.col(away).alias("first_id"), F.col(tie).alias("first_tie"), "text"), words, seed, ("first_id", "first_tie"), width), "fingerprints")
    # a null sorts last
    rank = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_tie")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min(rank).alias("row"), F.count("*").alias("n")), "nodes")
    loose = connected_components(written(near_links(nodes.select("fp", "node", "size"), radius, width, least=least), "candidates"))
    # the sets of one row for each candidate
    rows = written(nodes.join(loose, "node").select("node", "size", "fp", "component", "row.first_id", "row.first_tie"), "candidate-rows")
    texts = _rows_of(keyed, rows, "doc_id", tie).select("text")
    sets = _sets(texts, words, seed, ()).select("node", "shingles").dropDuplicates(["node"])
    members = written(rows.select("component", "node", "size", "fp").join(sets, "node"), "members")
    classes = connected_components(written(verified_links(members, radius, width, least), "links"))
    # every row but the first of its class goes, and of equal rows all but one
    classed = prints.join(classes, "node", "left").select(F.coalesce("component", "node").alias("class"), "first_id", "first_tie")
    counted = classed.groupBy("class", "first_id", "first_tie").agg(F.count("*").alias("n"))
    counted = written(counted, "rows")
    firsts = counted.groupBy("class").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_tie", "n")).alias("first"))
    firsts = written(firsts.select("first.first_id", "first.first_tie", "first.n"), "firsts")
    same = lambda a, b: a["first_id"].eqNullSafe(b["first_id"]) & (a["first_tie"] == b["first_tie"])
    gone = written(counted.join(firsts, same(counted, firsts), "left_anti").select("first_id", "first_tie"), "gone")
    twins = firsts.filter("n > 1").select("first_id", "first_tie")
    bucket = lambda a, b: F.pmod(F.xxhash64(F.coalesce(F.col(a), F.lit(0)), F.col(b)), F.lit(FILTER_BUCKETS))
    listed = written(gone.unionByName(twins).select(bucket("first_id", "first_tie").alias("bucket_of")).distinct(), "buckets")
    kept = keyed.join(F.broadcast(listed), bucket("doc_id", tie) == F.col("bucket_of"), "left_anti").select(*columns)
    # rows that stay though their bucket is listed
    doubtful = written(firsts.join(F.broadcast(listed), bucket("first_id", "first_tie") == F.col("bucket_of"), "left_semi").select("first_id", "first_tie"), "doubtful")
    return kept.unionByName(_rows_of(keyed, doubtful, "doc_id", tie).dropDuplicates(["doc_id", tie]).select(*columns))

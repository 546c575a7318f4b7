"""Token ids in Arrow IPC files of fixed-size-list batches: equal-length sequences and masks, read with zero copy.

Documents are range-partitioned and sorted by doc_id; a task encodes its partition's texts one after the other and
writes one shard: `ids` (fixed_size_list of unsigned 16-bit integers, 32-bit for larger vocabularies) and `mask`
(fixed_size_list of booleans: false only behind the shard's last id), BATCH sequences a record batch, so that
position // (BATCH * seq_len) is the batch and the rest the place in it. A second small file has doc_id, start within
the shard, and count. Tasks write under a name of their own attempt and rename at the end, so an attempt that was lost
leaves no half-written shard. The driver keeps a row for each shard, whose running sum is each shard's global start.

Null or empty text: the end id alone. Null doc_id: first. Repeated ids: in order of a hash of the text. Empty table:
no files, no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, work_path
from .tokens import encoder

BATCH = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """add() ids of one document after the other; close() puts both files in place."""

    def __init__(self, folder: str, shard: int, seq_len: int, dtype: str, attempt: int):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.seq_len, self.dtype, self.attempt = shard, seq_len, np.dtype(dtype), attempt
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.stream = self.fs.open_output_stream(self._path("ids", True))
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.index: list[tuple] = []

    def _path(self, kind: str, draft: bool) -> str:
        return f"{self.folder}/{kind}-{self.shard:06d}.arrow" + f".{self.attempt}" * draft

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.seq_len:
            self._write(False)

    def _write(self, last: bool) -> None:
        flat, size = np.concatenate(self.held), BATCH * self.seq_len
        whole = len(flat) if last else len(flat) // size * size
        for at in range(0, whole, size):
            part = flat[at : min(at + size, whole)]
            rows = -(-len(part) // self.seq_len)
            ids = np.zeros(rows * self.seq_len, self.dtype)
            ids[: len(part)] = part
            mask = np.arange(len(ids)) < len(part)
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
        self.held = [flat[whole:].copy()]
        self.n_held = len(flat) - whole

    def close(self) -> tuple[str, str, int]:
        if self.n_held:
            self._write(True)
        self.file.close()
        self.stream.close()
        with self.fs.open_output_stream(self._path("index", True)) as out, pa.ipc.new_file(out, _INDEX) as f:
            columns = list(zip(*self.index, strict=True)) or [(), (), ()]
            f.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_INDEX))
        for kind in ("ids", "index"):
            self.fs.move(self._path(kind, True), self._path(kind, False))
        return self._path("ids", False), self._path("index", False), self.total


class ShardReader:
    """Random access to a shard; on a local file the arrays are views of the mapped file."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        batch, row = self.file.get_batch(k // BATCH), k % BATCH
        cut = slice(row * self.seq_len, (row + 1) * self.seq_len)
        return batch.column(0).flatten().to_numpy()[cut], batch.column(1).flatten().to_numpy(zero_copy_only=False)[cut]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position of the shard on."""
        size, parts = BATCH * self.seq_len, []
        while n > 0:
            values = self.file.get_batch(start // size).column(0).flatten().to_numpy()
            part = values[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "uint16")


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, seq_len: int = 2048, end_id: int = 1) -> list[tuple[int, str, str, int]]:
    """Writes the shards; (shard, ids file, index file, ids) of each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, out = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), None
        context = TaskContext.get()
        for batch in slices(batches, "text"):
            out = out or ShardWriter(folder, context.partitionId(), seq_len, "uint16" if max(enc.vocab, end_id + 1) <= 1 << 16 else "uint32", context.taskAttemptId())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.add(doc_id, np.frombuffer(enc.encode(text) + end, "<u4"))
        if out:
            ids, index, n = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "ids": [ids], "index": [index], "n": [n]}, schema=pa.schema([("shard", pa.int64()), ("ids", pa.string()), ("index", pa.string()), ("n", pa.int64())]))

    order = ["doc_id", "text_hash"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "shard long, ids string, index string, n long").collect())


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, str, str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for ids_path, index_path, base in zip(*(batch.column(c).to_pylist() for c in ("ids", "index", "base")), strict=True):
                reader = ShardReader(fs, ids_path)
                with fs.open_input_file(index_path) as f:
                    index = pa.ipc.open_file(f).read_all()
                for part in index.to_batches(max_chunksize=4096):
                    start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(reader.ids(a, k).astype("<u4")) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    bases = [0, *accumulate(s[3] for s in shards)]
    files = spark.createDataFrame([(s[0], s[1], s[2], b) for s, b in zip(shards, bases, strict=False)], "shard long, ids string, index string, base long")
    spread = files.repartitionByRange(max(1, min(len(shards), shuffle_partitions(spark))), "shard")
    return spread.select("ids", "index", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, folder: str | None = None, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    folder = folder or work_path(docs.sparkSession, "sequences")
    return read_documents(docs.sparkSession, folder, write_sequences(docs, tokenizer, folder, seq_len, end_id))

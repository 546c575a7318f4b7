"""Files to documents, documents to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import data_url
from ..functions.regexes import strip

#: The kinds of file that are taken, and what they are called on the wire.
MIME = {".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}

#: From a file's bytes to its pages' texts; from a PDF's bytes to its pages as PNG. Injected: none is part of this package.
Reader = Callable[[bytes], list[str]]
Renderer = Callable[[bytes], list[bytes]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, content, suffix, length of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content", suffix(F.col("path")).alias("suffix"), "length")


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of a kind that is taken, with content; and the others with the reason."""
    reason = F.when(~F.col("suffix").isin(*MIME), F.lit("unsupported_type")).when(F.coalesce("length", F.lit(0)) == 0, F.lit("empty_file"))
    marked = files.withColumn("reason", F.when(F.col("suffix").isNull(), F.lit("unsupported_type")).otherwise(reason))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").drop("content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text of every text file below path."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return texts.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def page_texts(files: DataFrame, reader: Reader) -> DataFrame:
    """doc_id, page_no, text: what a reader gives for each page; none where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                try:
                    pages = reader(bytes(content))
                except Exception:  # a file that its reader can't open has no text; it stays a document
                    pages = []
                rows += [(doc_id, k, p) for k, p in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, page_no int, text string")


def join_pages(pages: DataFrame, key: str = "doc_id", order: str = "page_no", text: str = "text") -> DataFrame:
    """One text for each document: its non-blank pages, stripped, in order, a blank line between."""
    told = pages.select(key, F.col(order).alias("o"), strip(F.col(text)).alias("t")).filter("t <> ''")
    gathered = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("p"))
    return gathered.select(key, F.array_join(F.transform("p", lambda s: s["t"]), "\n\n").alias("text"))


def page_images(files: DataFrame, renderer: Renderer, most: int | None = None) -> DataFrame:
    """doc_id, page_no, png of each page of a PDF, the first `most` if given; an image is its own page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, kind, content in zip(f["doc_id"], f["suffix"], f["content"], strict=True):
                pages = renderer(bytes(content)) if kind == ".pdf" else [bytes(content)]
                rows += [(doc_id, k, p) for k, p in enumerate(pages[:most])]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "png"])

    return files.select("doc_id", "suffix", "content").mapInPandas(run, "doc_id long, page_no int, png binary")


def with_data_url(files: DataFrame) -> DataFrame:
    mime = F.create_map(*[F.lit(x) for p in MIME.items() for x in p])[F.col("suffix")]
    return files.withColumn("data_url", data_url(F.col("content"), mime))


def text_sources(*readers: DataFrame) -> DataFrame:
    """doc_id, sources: the texts that several readers (doc_id, text) gave, in the order of the readers."""
    every = None
    for k, r in enumerate(readers):
        part = r.select("doc_id", F.lit(k).alias("k"), "text")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["text"]).alias("sources"))

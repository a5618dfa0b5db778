"""Self-referential factorisation of texts and its inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import kernels
from runloom.sources import readers

FACTORS = "doc_id bigint, factor_no bigint, beg bigint, len bigint, ch int"


#: Bytes of texts that are factorised together: their arrays stay in a core's cache.
TOGETHER = 1 << 15


def _factorised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a few texts at a time the ids of those that are not empty, how many factors each has, and beg, len and ch of all."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text := text.as_py():
                ids.append(doc)
                texts.append(text)
                size += len(text)
            if size >= TOGETHER:
                yield ids, *kernels.factor_arrays(texts)
                ids, texts, size = [], [], 0
        if ids:
            yield ids, *kernels.factor_arrays(texts)


def factorise(docs: DataFrame) -> DataFrame:
    """(doc_id, factor_no, beg, len, ch) of (doc_id, text binary). An empty text has no factor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, beg, length, ch in _factorised(batches):
            doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
            number = np.arange(len(beg)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.record_batch([doc, pa.array(number), pa.array(beg), pa.array(length), pa.array(ch.astype(np.int32))], names=["doc_id", "factor_no", "beg", "len", "ch"])

    return docs.select("doc_id", "text").mapInArrow(rows, FACTORS)


def factorise_files(docs: DataFrame, folder: str, folders: int = 1) -> DataFrame:
    """Factor files of (doc_id, text binary), as readers.factor_files(factorise(docs)) written; by the task that has the text, without a row for each factor."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for ids, counts, beg, length, ch in _factorised(batches):
            content = readers.records(beg, length, ch)
            cuts = [0, *(np.cumsum(counts) * readers.RECORD_BYTES).tolist()]
            yield from ((doc, content[cuts[i] : cuts[i + 1]]) for i, doc in enumerate(ids))

    return readers.write_files(docs.select("doc_id", "text"), folder, ".lz", encoded, folders)


def decode_files(spark: SparkSession, folder: str, texts: str, folders: int = 1) -> DataFrame:
    """Text files of the factor files in a folder, each by one task."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for doc, content in readers.contents(batches):
            beg, length, ch = readers.from_records(content)
            if len(beg):
                yield doc, kernels.unfactorise(zip(beg.tolist(), length.tolist(), ch.tolist(), strict=True))

    return readers.write_files(readers.listed_files(spark, folder, ".lz"), texts, ".txt", decoded, folders)


def summary(factors: DataFrame) -> DataFrame:
    """(doc_id, z, n): number of factors and length of the text."""
    return factors.groupBy("doc_id").agg(F.count("*").alias("z"), F.sum(F.col("len") + 1).alias("n"))


def decode(factors: DataFrame) -> DataFrame:
    """(doc_id, text binary): each copied part may run into what it makes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kernels.unfactorise([(f["beg"], f["len"], f["ch"]) for f in row.as_py()]) for row in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    ordered = factors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("factor_no", "beg", "len", "ch"))).alias("f"))
    return ordered.mapInArrow(rows, "doc_id bigint, text binary")

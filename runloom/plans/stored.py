"""An index that is stored and asked again: a row for each text, in size of its runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import kernels
from runloom.functions.runindex import RunIndex

#: (doc_id, length, end marker's row, position after it, runs' symbols, starts and first positions, next-position map).
INDEX = "doc_id bigint, n bigint, em_pos bigint, after_em bigint, run_ch binary, run_start binary, run_head binary, next_key binary, next_val binary"
_NAMES = [part.split()[0] for part in INDEX.split(", ")]
_KINDS = [pa.binary() if part.endswith("binary") else pa.int64() for part in INDEX.split(", ")]


def build(docs: DataFrame) -> DataFrame:
    """INDEX rows of (doc_id, text binary); write them to Parquet to ask them again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [(doc, *RunIndex.of(np.frombuffer(text.as_py(), np.uint8)).packed()) for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.record_batch([pa.array([f[i] for f in found], k) for i, k in enumerate(_KINDS)], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(rows, INDEX)


def _asked(index: DataFrame, patterns: list[bytes], schema: str, work) -> DataFrame:
    names, kinds = [p.split()[0] for p in schema.split(", ")], [pa.int64() for _ in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = RunIndex.unpacked(*packed)
                for i, pattern in enumerate(patterns):
                    left, right, txt = own.find(pattern)
                    columns = work(own, left, right, txt, len(pattern))
                    n = len(columns[0])
                    yield pa.record_batch([pa.array(np.asarray(c, np.int64), k) for c, k in zip((np.full(n, doc), np.full(n, i), *columns), kinds, strict=True)], names=names)

    return index.select(*_NAMES).mapInArrow(rows, schema)


def count(index: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(doc_id, pat_id, n_occ) from INDEX rows."""
    return _asked(index, patterns, "doc_id bigint, pat_id bigint, n_occ bigint", lambda own, left, right, txt, n: [[right - left]])


def locate(index: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(doc_id, pat_id, bwt_pos, beg) of every occurrence, from INDEX rows."""
    return _asked(index, patterns, "doc_id bigint, pat_id bigint, bwt_pos bigint, beg bigint", lambda own, left, right, txt, n: [np.arange(left, right), own.places(left, right, txt) - n])


def sizes(index: DataFrame) -> DataFrame:
    """(doc_id, n, r, bytes of the runs, of the next-position map, of both a byte of the text)."""
    runs = F.octet_length("run_ch") + F.octet_length("run_start") + F.octet_length("run_head")
    entries = F.octet_length("next_key") + F.octet_length("next_val")
    return index.select("doc_id", "n", F.octet_length("run_ch").cast("bigint").alias("r"), runs.cast("bigint").alias("run_bytes"), entries.cast("bigint").alias("map_bytes"), F.when(F.col("n") > 0, (runs + entries) / F.col("n")).alias("bytes_per_symbol"))


def check_inversion(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, same): each text against the inverse of its transform, text by text, without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_, same = [], []
            for text in batch.column(1):
                symbols = np.frombuffer(text.as_py(), np.uint8)
                order = kernels.prefix_order(symbols)
                follow = np.append(symbols.astype(np.int64), -1)[order]
                sizes_.append(len(symbols))
                same.append(kernels.invert(follow, int(np.flatnonzero(follow < 0)[0])).astype(np.uint8).tobytes() == text.as_py())
            yield pa.record_batch([batch.column(0), pa.array(sizes_, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_bytes", "same"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_bytes bigint, same boolean")

"""The engine's relations: transform rows, runs, alphabet, next-position map.

bwt(doc_id, bwt_pos, txt_pos, ch): a row for each prefix of each text, in the
order of prefixes compared from right to left; ch is null on the row of the
whole text, the end marker's. All others derive from it by windows and
aggregates on one partitioning by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import kernels

_CHUNK = 1 << 18


def by_row():
    return Window.partitionBy("doc_id").orderBy("bwt_pos")


def by_run():
    return Window.partitionBy("doc_id").orderBy("run_id")


def bwt(docs: DataFrame, column: str = "text") -> DataFrame:
    """Transform rows of (doc_id, text binary), or of (doc_id, symbols array<int>) with column="symbols"."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            size = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py()
                symbols = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else np.array(raw or [], np.int64)
                order = kernels.prefix_order(symbols)
                ch = np.append(symbols.astype(np.int32), -1)[order]
                held.append([np.full(len(order), doc), np.arange(len(order)), order, ch])
                size += len(order)
                if size > _CHUNK:
                    yield from _emit(held)
                    held, size = [], 0
            if held:
                yield from _emit(held)

    return docs.select("doc_id", column).mapInArrow(rows, "doc_id bigint, bwt_pos bigint, txt_pos bigint, ch int")


def _emit(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    doc, row, txt, ch = (np.concatenate([h[i] for h in held]) for i in range(4))
    for at in range(0, len(doc), _CHUNK):
        part = slice(at, at + _CHUNK)
        follow = pa.array(ch[part], pa.int32(), mask=ch[part] < 0)
        yield pa.record_batch([pa.array(doc[part], pa.int64()), pa.array(row[part], pa.int64()), pa.array(txt[part], pa.int64()), follow], names=["doc_id", "bwt_pos", "txt_pos", "ch"])


def _each_text(docs: DataFrame, column: str, schema: str, work) -> DataFrame:
    """Rows that work(symbols, order) gives as arrays for each text, with its doc_id, without shuffling transform rows."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int32() if part.split()[1] == "int" else pa.float64() if part.split()[1] == "double" else pa.int64() for part in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            size = 0
            for doc, value in [*zip(batch.column(0).to_pylist(), batch.column(1), strict=True), (None, None)]:
                if value is not None:
                    raw = value.as_py()
                    symbols = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else np.array(raw or [], np.int64)
                    found = work(symbols, kernels.prefix_order(symbols))
                    held.append([np.full(len(found[0]), doc), *found])
                    size += len(found[0])
                if held and (value is None or size > _CHUNK):
                    columns = [np.concatenate([h[i] for h in held]) for i in range(len(kinds))]
                    yield pa.record_batch([pa.array(c, k, from_pandas=k == pa.float64()) for c, k in zip(columns, kinds, strict=True)], names=names)
                    held, size = [], 0

    return docs.select("doc_id", column).mapInArrow(rows, schema)


def _run_starts(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows without the marker's, their symbols, places where a run starts)."""
    ends = order[order < len(symbols)]
    follow = symbols[ends]
    return ends, follow, np.flatnonzero(np.concatenate(([True], follow[1:] != follow[:-1]))) if len(follow) else np.zeros(0, np.int64)


def text_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """runs() straight from texts: for run-compressed storage, where the rows themselves aren't wanted."""

    def work(symbols: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        ends, follow, starts = _run_starts(symbols, order)
        stops = np.append(starts[1:], len(follow))
        return [np.arange(len(starts)), follow[starts], stops - starts, starts, ends[starts], ends[stops - 1] if len(starts) else starts]

    return _each_text(docs, column, "doc_id bigint, run_id bigint, ch int, run_len bigint, rle_start bigint, head_txt bigint, tail_txt bigint", work)


def text_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """stats() straight from texts."""

    def work(symbols: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        n, r = len(symbols), len(_run_starts(symbols, order)[2])
        return [np.array([x]) for x in (n, r, len(np.unique(symbols)), np.flatnonzero(order == n)[0], n / r if r else np.nan)]

    return _each_text(docs, column, "doc_id bigint, n bigint, r bigint, sigma bigint, em_pos bigint, n_per_run double", work)


def text_next_position_map(docs: DataFrame, column: str = "text") -> DataFrame:
    """next_position_map() straight from texts."""

    def work(symbols: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        follow = np.append(symbols.astype(np.int64), -1)[order]
        last = np.flatnonzero(follow[1:] != follow[:-1])
        return [order[last], order[last + 1]]

    return _each_text(docs, column, "doc_id bigint, key bigint, val bigint", work)


def marker_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, em_pos, n): the end marker's row and the text's length."""
    return rows.where("ch is null").select("doc_id", F.col("bwt_pos").alias("em_pos"), F.col("txt_pos").alias("n"))


def without_marker(rows: DataFrame) -> DataFrame:
    """Rows with a symbol, with rle_pos: their place when the marker's row is left out."""
    em = F.max(F.when(F.col("ch").isNull(), F.col("bwt_pos"))).over(Window.partitionBy("doc_id"))
    marked = rows.withColumn("em_pos", em).where("ch is not null")
    return marked.withColumn("rle_pos", F.col("bwt_pos") - (F.col("bwt_pos") > F.col("em_pos")).cast("bigint")).drop("em_pos")


def runs(rows: DataFrame) -> DataFrame:
    """(doc_id, run_id, ch, run_len, rle_start, head_txt, tail_txt): maximal runs of equal symbols; the marker doesn't break one."""
    by_place = Window.partitionBy("doc_id").orderBy("rle_pos")
    starts = without_marker(rows).withColumn("new", F.coalesce((F.col("ch") != F.lag("ch").over(by_place)).cast("int"), F.lit(0)))
    numbered = starts.withColumn("run_id", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return numbered.groupBy("doc_id", "run_id").agg(
        F.min("ch").alias("ch"),
        F.count("*").alias("run_len"),
        F.min("rle_pos").alias("rle_start"),
        F.min_by("txt_pos", "rle_pos").alias("head_txt"),
        F.max_by("txt_pos", "rle_pos").alias("tail_txt"),
    )


def alphabet(rows: DataFrame) -> DataFrame:
    """(doc_id, ch, occ, c_before): counts of symbols and of all smaller ones."""
    counts = rows.where("ch is not null").groupBy("doc_id", "ch").agg(F.count("*").alias("occ"))
    before = Window.partitionBy("doc_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("c_before", F.coalesce(F.sum("occ").over(before), F.lit(0)))


def last_to_first(rows: DataFrame) -> DataFrame:
    """(doc_id, bwt_pos, lf): the row of the prefix that is one longer; 0 for the marker's row."""
    target = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ch").asc_nulls_first(), "bwt_pos")) - 1
    return rows.select("doc_id", "bwt_pos", target.cast("bigint").alias("lf"))


def next_positions(rows: DataFrame) -> DataFrame:
    """(doc_id, txt_pos, next_txt): the text position of the row that follows; null on the last row."""
    return rows.select("doc_id", "txt_pos", F.lead("txt_pos").over(by_row()).alias("next_txt"))


def next_position_map(rows: DataFrame) -> DataFrame:
    """(doc_id, key, val): text positions at the ends of stretches of rows with one symbol, and those of the rows that follow.

    The marker's row is a stretch of its own here. One entry for each run
    answers the next position of every row: between two keys the distance to
    the key is kept.
    """
    following = F.lead("ch").over(by_row())
    ends = rows.select("doc_id", F.col("txt_pos").alias("key"), F.lead("txt_pos").over(by_row()).alias("val"), (~F.col("ch").eqNullSafe(following)).alias("last"))
    return ends.where("last and val is not null").select("doc_id", "key", "val")


def stats(rows: DataFrame) -> DataFrame:
    """(doc_id, n, r, sigma, em_pos, n_per_run)."""
    by_place = Window.partitionBy("doc_id").orderBy("rle_pos")
    broken = without_marker(rows).withColumn("new", F.coalesce((F.col("ch") != F.lag("ch").over(by_place)).cast("int"), F.lit(1)))
    counted = broken.groupBy("doc_id").agg(F.sum("new").cast("bigint").alias("r"), F.countDistinct("ch").alias("sigma"))
    ends = marker_rows(rows)
    joined = ends.join(counted, "doc_id", "left").select("doc_id", "n", F.coalesce("r", F.lit(0)).cast("bigint").alias("r"), F.coalesce("sigma", F.lit(0)).cast("bigint").alias("sigma"), "em_pos")
    return joined.withColumn("n_per_run", F.when(F.col("r") > 0, F.col("n") / F.col("r")))

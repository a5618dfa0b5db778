"""Texts that grow: keyed state in Structured Streaming.

The stream brings pieces (doc_id, seq, text). A text is its pieces in the
order of seq, whatever batch brought them; seq is the position among the
text's pieces, from 0. A piece that comes before one that is still missing
waits in the state, and every row says how many wait. A piece with a seq below
0 drops the text's state first: the text begins again with seq 0. Nothing else
is evicted: an index must keep its text.

State holds the text's transform, which a batch extends by what it brings, and
the open factor. Questions are answered from it without the batches before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.growing import Growing

STATE = "text binary, follow binary, places binary, marker bigint, start bigint, l bigint, r bigint, closed bigint, waiting map<bigint, binary>, next bigint"
SIZES = "doc_id bigint, n bigint, r bigint, sigma bigint, n_bytes bigint, waiting bigint"
FACTORS = "doc_id bigint, factor_no bigint, beg bigint, len bigint, ch int, final boolean"
FOUND = "doc_id bigint, pat_id bigint, n_occ bigint, begs array<bigint>"


def _grown(pdfs: Iterator[pd.DataFrame], state) -> tuple[Growing, list[tuple[int, int, int, int]], int]:
    """The text after the batch's pieces, the factors they made final, how many pieces wait; updates the state."""
    index, waiting, following = Growing(), {}, 0
    if state.exists:
        *packed, held, following = state.get
        index, waiting = Growing.unpacked(*packed), {int(k): bytes(v) for k, v in dict(held).items()}
    got = [(int(seq), b"" if piece is None else bytes(piece)) for pdf in pdfs for seq, piece in zip(pdf["seq"], pdf["text"], strict=True)]
    if any(seq < 0 for seq, _ in got):
        index, waiting, following = Growing(), {}, 0
    waiting.update((seq, piece) for seq, piece in got if seq >= following)
    parts = []
    while following in waiting:
        parts.append(waiting.pop(following))
        following += 1
    factors = index.extend(b"".join(parts))
    state.update((*index.packed(), waiting, following))
    return index, factors, len(waiting)


def _append(key, pdfs, state):
    index, _, waiting = _grown(pdfs, state)
    n, r, sigma = index.sizes()
    yield pd.DataFrame({"doc_id": [key[0]], "n": [n], "r": [r], "sigma": [sigma], "n_bytes": [sum(map(len, index.packed()[:3]))], "waiting": [waiting]})


def _factors(key, pdfs, state):
    index, found, _ = _grown(pdfs, state)
    last = index.open_factor()
    rows = [(*f, True) for f in found] + ([(*last, False)] if last else [])
    kinds = {"factor_no": "int64", "beg": "int64", "len": "int64", "ch": "int32", "final": "bool"}
    yield pd.DataFrame({"doc_id": [key[0]] * len(rows), **{name: [row[i] for row in rows] for i, name in enumerate(kinds)}}).astype({"doc_id": "int64", **kinds})


def grow_index(pieces: DataFrame) -> DataFrame:
    """A row (doc_id, n, r, sigma, n_bytes, waiting) for each text that a batch has grown; n_bytes: of its index."""
    return pieces.groupBy("doc_id").applyInPandasWithState(_append, SIZES, STATE, "update", "NoTimeout")


def grow_factors(pieces: DataFrame) -> DataFrame:
    """Factors as soon as they are final, and with each batch the text's last one as it is if the text ends there (final is false)."""
    return pieces.groupBy("doc_id").applyInPandasWithState(_factors, FACTORS, STATE, "append", "NoTimeout")


def grow_answers(pieces: DataFrame, patterns: Sequence[bytes]) -> DataFrame:
    """A row (doc_id, pat_id, n_occ, begs) for each pattern and text that a batch has grown: answers as of that batch."""

    def answer(key, pdfs, state):
        index, _, _ = _grown(pdfs, state)
        begs = [index.begins(p) for p in patterns]
        yield pd.DataFrame({"doc_id": [key[0]] * len(patterns), "pat_id": range(len(patterns)), "n_occ": [len(b) for b in begs], "begs": begs})

    return pieces.groupBy("doc_id").applyInPandasWithState(answer, FOUND, STATE, "update", "NoTimeout")


def latest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of drained() rows those of each key's last batch."""
    last = rows.groupBy(*by).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*by, "batch"]).drop("batch")


def complete_factors(rows: DataFrame) -> DataFrame:
    """(doc_id, factor_no, beg, len, ch) of texts whose stream has ended, from the drained rows of grow_factors()."""
    last = latest(rows.where("not final"), ["doc_id"])
    open_ = last.join(rows.where("final").select("doc_id", "factor_no"), ["doc_id", "factor_no"], "left_anti")
    return rows.where("final").drop("batch").unionByName(open_).drop("final")


def pieces_of(spark: SparkSession, path: str, schema, id_col: str, seq_col: str, text_col: str, files_per_batch: int = 1) -> DataFrame:
    """(doc_id, seq, text binary) from a folder of Parquet files, or a single one, files_per_batch at a time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        read = reader.parquet(path)
    else:  # a stream's source is a folder
        read = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return read.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(seq_col).cast("bigint").alias("seq"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


PROGRESS = "batch bigint, n_rows bigint, rows_per_second double, state_rows bigint, state_bytes bigint, took_ms bigint"


def drained(stream: DataFrame, mode: str, folder: str, query: Callable[[DataFrame], DataFrame] | None = None, progress: list[tuple] | None = None) -> DataFrame:
    """All rows that the stream gives for the input there is now, with the number of their batch.

    Batches are written under their number, so a batch that runs again after a
    failure replaces its own rows. progress gets a row (PROGRESS) for each.
    """
    base = f"{folder}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        (query(df) if query else df).write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    spark = stream.sparkSession
    if progress is not None:
        for p in run.recentProgress:
            states = p.stateOperators
            progress.append((p.batchId, p.numInputRows, float(p.processedRowsPerSecond), sum(s.numRowsTotal for s in states), sum(s.memoryUsedBytes for s in states), p.batchDuration))
    if run.lastProgress is None:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(None).cast("int"))
    return spark.read.option("basePath", f"{base}/rows").schema(f"{_ddl(stream)}, batch int").parquet(f"{base}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

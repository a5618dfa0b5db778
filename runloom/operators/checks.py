"""Inversion and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import kernels
from runloom.operators.asof import asof
from runloom.plans import relations as R


def invert(rows: DataFrame) -> DataFrame:
    """(doc_id, text binary) from bwt_pos and ch alone, by last-to-first steps.

    The rows of a text arrive in order, so a task holds the symbols of one
    text at a time.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owner = None
        for batch in batches:
            docs = batch.column(0).to_numpy()
            follow = batch.column(1).fill_null(-1).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(docs[1:] != docs[:-1]) + 1
            done, texts = [], []
            for beg, end in zip([0, *cuts], [*cuts, len(docs)], strict=True):
                if held and end > beg and docs[beg] != owner:
                    done.append(owner)
                    texts.append(_walk(held))
                    held = []
                if end > beg:
                    owner = docs[beg]
                    held.append(follow[beg:end])
            yield pa.record_batch([pa.array(done, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
        if held:
            yield pa.record_batch([pa.array([owner], pa.int64()), pa.array([_walk(held)], pa.binary())], names=["doc_id", "text"])

    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "bwt_pos").select("doc_id", "ch")
    return ordered.mapInArrow(walked, "doc_id bigint, text binary")


def _walk(parts: list[np.ndarray]) -> bytes:
    follow = np.concatenate(parts)
    return kernels.invert(follow, int(np.flatnonzero(follow < 0)[0])).astype(np.uint8).tobytes()


def roundtrip(docs: DataFrame, restored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, same): texts are the same by length and SHA-256, so that none is shuffled."""
    other = restored.select("doc_id", *_digest(F.col("text"), "restored"))
    own = docs.select("doc_id", *_digest(F.col("text"), "text"))
    empty_bytes, empty = _digest(F.lit(b""), "empty")
    same = (F.col("text_bytes") == F.coalesce("restored_bytes", empty_bytes)) & (F.col("text") == F.coalesce("restored", empty))
    return own.join(other, "doc_id", "left").select("doc_id", F.col("text_bytes").alias("n_bytes"), F.coalesce(same, F.lit(False)).alias("same"))


def _digest(text: F.Column, name: str) -> tuple[F.Column, F.Column]:
    return F.octet_length(text).cast("bigint").alias(f"{name}_bytes"), F.sha2(text, 256).alias(name)


def expand(runs: DataFrame) -> DataFrame:
    """(doc_id, expanded): the runs' symbols in order as upper-case hex."""
    piece = F.expr("repeat(lpad(hex(ch), 2, '0'), cast(run_len as int))")
    ordered = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run_id", piece.alias("h")))).alias("p"))
    return ordered.select("doc_id", F.array_join(F.transform("p", lambda x: x["h"]), "").alias("expanded"))


def chain_check(rows: DataFrame) -> DataFrame:
    """(doc_id, n_rows, n_bad): rows whose last-to-first target isn't the row of the prefix that is one longer."""
    step = R.last_to_first(rows).join(rows.select("doc_id", "bwt_pos", "txt_pos", "ch"), ["doc_id", "bwt_pos"])
    goal = rows.select("doc_id", F.col("bwt_pos").alias("goal"), F.col("txt_pos").alias("want"))
    want = F.when(F.col("ch").isNull(), F.lit(0)).otherwise(F.col("txt_pos") + 1)
    joined = step.withColumn("want", want).join(goal, ["doc_id", "want"], "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.col("lf") == F.col("goal"), F.lit(False))).alias("n_bad"))


def next_position_by_map(rows: DataFrame) -> DataFrame:
    """(doc_id, txt_pos, next_txt) from the map alone: the nearest key ahead, less the distance to it; null on the last row."""
    asked = rows.withColumn("last", F.lead("bwt_pos").over(R.by_row()).isNull()).where("not last").select("doc_id", F.col("txt_pos").alias("key"))
    entries = R.next_position_map(rows).select("doc_id", "key", F.col("key").alias("at"), "val")
    found = asof(asked, entries, ["doc_id"], "key", ["at", "val"], forward=True)
    return found.select("doc_id", F.col("key").alias("txt_pos"), (F.col("val") - (F.col("at") - F.col("key"))).alias("next_txt"))


def run_invariants(runs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, n_empty, n_unmerged): runs without weight, runs with the symbol of the one before."""
    order = Window.partitionBy("doc_id").orderBy("run_id")
    marked = runs.withColumn("again", F.coalesce(F.col("ch") == F.lag("ch").over(order), F.lit(False)))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("run_len") <= 0).alias("n_empty"), F.count_if("again").alias("n_unmerged"))

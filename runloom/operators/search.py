"""Pattern queries: intervals, counts, places, matched starts, also as of a prefix of the text.

Two forms give the same answers. The index form steps an interval through the
pattern on the transform rows, all patterns and texts at once: a step is two
as-of lookups of occurrence counts. The scan form looks at every start of the
text and needs no index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import kernels
from runloom.operators.asof import asof
from runloom.operators.points import occurrences
from runloom.plans import relations as R


def intervals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pat_id, plen, matched, l, r, n_occ) for every text and pattern, by interval steps on each text's rows.

    l and r are null if the pattern doesn't occur. patterns(pat_id, pattern)
    is small and goes along with each task: the bound is checked.
    """
    wanted = _small(patterns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                symbols = np.frombuffer(text.as_py(), np.uint8)
                rows_of = kernels.Intervals(symbols, kernels.prefix_order(symbols))
                for pat, pattern in wanted:
                    left, right, matched = rows_of.find(np.frombuffer(pattern, np.uint8))
                    whole = matched == len(pattern)
                    out.append((doc, pat, len(pattern), matched, left if whole else None, right if whole else None, right - left if whole else 0))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "pat_id", "plen", "matched", "l", "r", "n_occ"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, pat_id bigint, plen int, matched int, l bigint, r bigint, n_occ bigint")


MAX_PATTERN_BYTES = 4 << 20


def _small(patterns: DataFrame) -> list[tuple[int, bytes]]:
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if size.n + 16 * size.rows > MAX_PATTERN_BYTES:
        raise ValueError(f"patterns of {size.n} bytes: use stepped_intervals(), which joins them")
    return [(r.pat_id, bytes(r.pattern)) for r in patterns.collect()]


def stepped_intervals(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """As intervals(), from transform rows alone, which may be stored.

    Each step looks up, for the open intervals, the counts of their next
    symbol before l and before r.
    """
    counts = occurrences(rows).select("doc_id", "ch", F.col("rle_pos").alias("at"), F.col("rank").alias("seen"))
    before = R.alphabet(rows).select("doc_id", "ch", "c_before")
    ends = R.marker_rows(rows)
    wanted = _small(patterns)
    longest = max((len(p) for _, p in wanted), default=0)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("pat_id"), F.lit(p).alias("pattern")) for i, p in wanted]))
    live = ends.withColumn("p", each).select("*", "p.pat_id", "p.pattern").select("doc_id", "pat_id", "pattern", "em_pos", "n", F.lit(0).cast("bigint").alias("l"), (F.col("n") + 1).alias("r"), F.lit(0).alias("matched"), F.lit(True).alias("open"))
    for step in range(longest):
        symbol = F.conv(F.hex(F.substring("pattern", step + 1, 1)), 16, 10).cast("int")
        asked = live.withColumn("ch", F.when(F.col("open"), symbol))
        for side in ("l", "r"):
            asked = asked.withColumn("at", F.col(side) - (F.col(side) > F.col("em_pos")).cast("bigint") - 1)
            asked = asof(asked, counts, ["doc_id", "ch"], "at", ["seen"]).withColumn(f"seen_{side}", F.coalesce("seen", F.lit(0))).drop("seen", "at")
        stepped = asked.join(before, ["doc_id", "ch"], "left")
        goes = F.col("open") & F.col("c_before").isNotNull() & (F.col("seen_r") > F.col("seen_l"))
        goes = F.coalesce(goes, F.lit(False))
        live = stepped.select(
            "doc_id", "pat_id", "pattern", "em_pos", "n",
            F.when(goes, F.col("c_before") + F.col("seen_l") + 1).otherwise(F.col("l")).alias("l"),
            F.when(goes, F.col("c_before") + F.col("seen_r") + 1).otherwise(F.col("r")).alias("r"),
            (F.col("matched") + goes.cast("int")).alias("matched"),
            goes.alias("open"),
        )
    whole = F.col("matched") == F.octet_length("pattern")
    return live.select("doc_id", "pat_id", F.octet_length("pattern").alias("plen"), "matched", F.when(whole, F.col("l")).alias("l"), F.when(whole, F.col("r")).alias("r"), F.when(whole, F.col("r") - F.col("l")).otherwise(F.lit(0)).cast("bigint").alias("n_occ"))


def locate(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, pat_id, bwt_pos, beg): every occurrence's begin; ordered by bwt_pos it is the index's own order."""
    hits = found.where("l is not null").select("doc_id", "pat_id", "plen", F.explode(F.sequence(F.col("l"), F.col("r") - 1)).alias("bwt_pos"))
    return hits.join(rows.select("doc_id", "bwt_pos", "txt_pos"), ["doc_id", "bwt_pos"]).select("doc_id", "pat_id", "bwt_pos", (F.col("txt_pos") - F.col("plen")).alias("beg"))


def listed(places: DataFrame) -> DataFrame:
    """(doc_id, pat_id, begs): the begins of each pattern as text, in the index's order."""
    ordered = places.groupBy("doc_id", "pat_id").agg(F.array_sort(F.collect_list(F.struct("bwt_pos", "beg"))).alias("p"))
    return ordered.select("doc_id", "pat_id", F.array_join(F.transform("p", lambda x: x["beg"].cast("string")), ", ").alias("begs"))


def first_occurrence(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, pat_id, first_end): text position of the interval's first row."""
    first = found.where("l is not null").select("doc_id", "pat_id", F.col("l").alias("bwt_pos"))
    return first.join(rows.select("doc_id", "bwt_pos", "txt_pos"), ["doc_id", "bwt_pos"]).select("doc_id", "pat_id", F.col("txt_pos").alias("first_end"))


def at_end(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with ends: whether the text ends with the pattern, that is, the interval holds the end marker's row."""
    joined = found.join(R.marker_rows(rows).select("doc_id", "em_pos"), "doc_id")
    inside = (F.col("em_pos") >= F.col("l")) & (F.col("em_pos") < F.col("r"))
    return joined.select("doc_id", "pat_id", F.coalesce(inside, F.lit(False)).alias("ends"))


def scan_counts(docs: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(doc_id, pat_id, n_occ), overlapping occurrences counted, by built-in functions over the bytes of whole texts.

    Works on the text with one character for each byte. Each begin is found
    with one more look for the rest of the pattern ahead of it.
    """
    flat = F.decode(F.col("text"), "ISO-8859-1")
    counts = [F.struct(F.lit(i).cast("bigint").alias("pat_id"), F.when(F.lit(len(p) == 0), F.octet_length("text") + 1).otherwise(F.regexp_count(flat, F.lit(_ahead(p)))).cast("bigint").alias("n_occ")) for i, p in enumerate(patterns)]
    return docs.select("doc_id", F.explode(F.array(*counts)).alias("c")).select("doc_id", "c.pat_id", "c.n_occ")


def _ahead(pattern: bytes) -> str:
    quoted = "".join(f"\\x{b:02x}" for b in pattern)
    return f"(?s){quoted[:4]}(?={quoted[4:]})" if len(pattern) > 1 else quoted


def scan_counts_as_of(docs: DataFrame, patterns: list[bytes], lengths: list[int]) -> DataFrame:
    """(doc_id, m, pat_id, n_occ): counts in the first m bytes, for each m."""
    parts = docs.select("doc_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m in lengths])).alias("m"), "text")
    cut = parts.select("doc_id", "m", F.struct("doc_id", "m").alias("k"), F.substring(F.col("text"), F.lit(1), F.col("m").cast("int")).alias("text"))
    return scan_counts(cut.select(F.col("k").alias("doc_id"), "text"), patterns).select("doc_id.doc_id", "doc_id.m", "pat_id", "n_occ")

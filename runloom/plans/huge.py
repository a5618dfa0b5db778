"""Transform rows of texts that are too long for one task, by prefix doubling on frames.

Nothing is collected but a number for each partition. Each round compares
twice as many symbols: a row's key is its rank and the rank of the prefix that
is `step` shorter; distinct keys are counted (with map-side sums), sorted by
ranges, and their running sums are the new ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.plans import relations as R
from runloom.sources.shared import shared_folder

_KEY = ["doc_id", "rank", "behind"]


#: Bytes of a text that are one row before they become a row each.
PIECE = 1 << 16


def symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, txt_pos, ch): a row for each byte of (doc_id, text binary), and one with a null symbol for the end.

    A text is cut into pieces, which are dealt to all tasks before their bytes
    become rows.
    """
    begs = F.explode(F.sequence(F.lit(0), F.octet_length("text"), F.lit(PIECE))).alias("beg")
    pieces = docs.select("doc_id", begs, "text").select("doc_id", "beg", F.octet_length("text").alias("n"), F.substring(F.col("text"), F.col("beg") + 1, F.lit(PIECE)).alias("piece"))
    pieces = pieces.repartition("doc_id", "beg")
    upto = F.least(F.lit(PIECE - 1), F.col("n") - F.col("beg"))  # the end's row is in the last piece
    places = pieces.select("doc_id", "beg", "n", "piece", F.explode(F.sequence(F.lit(0), upto)).alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("piece"), F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    return places.select("doc_id", (F.col("beg") + F.col("at")).cast("bigint").alias("txt_pos"), F.when(F.col("beg") + F.col("at") < F.col("n"), byte).alias("ch"))


def routed(docs: DataFrame, most_bytes: int = 64 << 20, parts: int = 8) -> DataFrame:
    """Transform rows of all texts: those of most_bytes or less by one task each, longer ones by prefix doubling."""
    small, large = docs.where(F.octet_length("text") <= most_bytes), docs.where(F.octet_length("text") > most_bytes)
    rows = R.bwt(small)
    return rows if large.isEmpty() else rows.unionByName(bwt(symbols(large), parts))


def running_start(keys: DataFrame, order: list[str], parts: int) -> DataFrame:
    """keys(..., n) with start: the sum of n over all keys that come before in order."""
    shared_folder(keys.sparkSession)
    ordered = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    placed = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33).cast("int"))
    sums = {r["_p"]: r.s for r in placed.groupBy("_p").agg(F.sum("n").alias("s")).collect()}  # a row for each partition
    total, starts = 0, []
    for p in range(max(sums, default=-1) + 1):
        starts.append((p, total))
        total += sums.get(p, 0)
    first = F.broadcast(keys.sparkSession.createDataFrame(starts, "_p int, _first bigint"))
    before = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(first, "_p").withColumn("start", F.col("_first") + F.coalesce(F.sum("n").over(before), F.lit(0))).drop("_at", "_p", "_first")


def bwt(chars: DataFrame, parts: int = 8, max_rounds: int = 40) -> DataFrame:
    """Transform rows (doc_id, bwt_pos, txt_pos, ch) of symbols (doc_id, txt_pos, ch), the end's included."""
    shared_folder(chars.sparkSession)
    last = chars.where("ch is not null").select("doc_id", (F.col("txt_pos") + 1).alias("txt_pos"), F.col("ch").cast("bigint").alias("rank"))
    rows = chars.select("doc_id", "txt_pos").join(last, ["doc_id", "txt_pos"], "left").select("doc_id", "txt_pos", F.coalesce("rank", F.lit(-1)).alias("rank"), F.lit(0).cast("bigint").alias("behind"))
    first = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    base = running_start(first, ["doc_id"], parts).select("doc_id", F.col("start").alias("base")).checkpoint(eager=True)
    n, step = rows.count(), 1
    for _ in range(max_rounds):
        keys = rows.groupBy(*_KEY).agg(F.count("*").alias("n"))
        ranked = running_start(keys, _KEY, parts)
        rows = rows.join(ranked.drop("n"), _KEY).select("doc_id", "txt_pos", F.col("start").alias("rank")).checkpoint(eager=True)
        if ranked.count() == n:
            placed = rows.join(base, "doc_id").select("doc_id", (F.col("rank") - F.col("base")).alias("bwt_pos"), "txt_pos")
            return placed.join(chars, ["doc_id", "txt_pos"]).select("doc_id", "bwt_pos", "txt_pos", F.col("ch").cast("int").alias("ch"))
        shorter = rows.select("doc_id", (F.col("txt_pos") + step).alias("txt_pos"), F.col("rank").alias("behind"))
        rows = rows.join(shorter, ["doc_id", "txt_pos"], "left").withColumn("behind", F.coalesce("behind", F.lit(-1)))
        step *= 2
    raise RuntimeError("prefix doubling: no end")

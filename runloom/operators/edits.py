"""Run-length strings that carry a value in each run: (doc_id, run_id, ch, weight, val).

Edits are frames of one edit for each string, applied to all strings at once
by arithmetic on their runs. Runs are numbered anew after an edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(runs: DataFrame) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum("weight").over(before), F.lit(0)))


def _numbered(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("run_id", "part")) - 1).cast("bigint").alias("run_id"), "ch", "weight", "val")


def _fresh(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, run_id, part, ch, weight, val): the runs that edits at place 0 make of strings without runs."""
    empty = edits.join(runs.select("doc_id").distinct(), "doc_id", "left_anti").where("pos = 0")
    return empty.select("doc_id", F.lit(0).cast("bigint").alias("run_id"), F.lit(0).alias("part"), F.col("new_ch").cast("int").alias("ch"), F.col("new_weight").cast("bigint").alias("weight"), F.col("val1").cast("bigint").alias("val"))


def _part(number: int, ch, weight, val) -> F.Column:
    return F.struct(F.lit(number).alias("part"), ch.cast("int").alias("ch"), weight.cast("bigint").alias("weight"), val.cast("bigint").alias("val"))


def insert_run(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, pos, new_ch, new_weight, val1, val2): the new run, with value val1, goes before place pos.

    Inside or at the head of a run of the same symbol it joins that run; at a
    head whose previous run has the symbol it joins that one; at another head
    it is a run of its own; inside another run it splits it, and the tail gets
    val2. pos equal to the length appends. Joined runs keep their value. A
    string without runs is empty: place 0 makes its first run.
    """
    order = Window.partitionBy("doc_id").orderBy("run_id")
    beside = {"prev_ch": F.lag("ch").over(order), "next_ch": F.lead("ch").over(order), "next_start": F.lead("start").over(order)}
    around = _placed(runs).withColumns(beside).join(edits, "doc_id", "left")
    end = F.col("start") + F.col("weight")
    last = F.col("next_start").isNull()
    here = F.coalesce((F.col("pos") >= F.col("start")) & ((F.col("pos") < end) | (last & (F.col("pos") == end))), F.lit(False))
    head, tail = F.col("pos") == F.col("start"), F.col("pos") == end
    same, prev_same = F.col("ch") == F.col("new_ch"), F.coalesce(F.col("prev_ch") == F.col("new_ch"), F.lit(False))
    # the run before one whose head the edit names takes the weight
    from_next = (F.col("pos") == F.col("next_start")) & same & (F.col("next_ch") != F.col("new_ch"))
    whole = _part(0, F.col("ch"), F.col("weight"), F.col("val"))
    grown = _part(0, F.col("ch"), F.col("weight") + F.col("new_weight"), F.col("val"))
    fresh = lambda n: _part(n, F.col("new_ch"), F.col("new_weight"), F.col("val1"))
    left = _part(0, F.col("ch"), F.col("pos") - F.col("start"), F.col("val"))
    right = _part(2, F.col("ch"), end - F.col("pos"), F.col("val2"))
    parts = (
        F.when(F.coalesce(from_next, F.lit(False)), F.array(grown))
        .when(~here, F.array(whole))
        .when(same, F.array(grown))
        .when(tail, F.array(whole, fresh(1)))
        .when(head & prev_same, F.array(whole))
        .when(head, F.array(fresh(-1), whole))
        .otherwise(F.array(left, fresh(1), right))
    )
    return _numbered(around.select("doc_id", "run_id", F.explode(parts).alias("p")).select("doc_id", "run_id", "p.*").unionByName(_fresh(runs, edits)))


def split_run(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, pos, val2): the run around place pos becomes two; at a head nothing changes."""
    around = _placed(runs).join(edits, "doc_id", "left")
    end = F.col("start") + F.col("weight")
    inside = F.coalesce((F.col("pos") > F.col("start")) & (F.col("pos") < end), F.lit(False))
    two = F.array(_part(0, F.col("ch"), F.col("pos") - F.col("start"), F.col("val")), _part(1, F.col("ch"), end - F.col("pos"), F.col("val2")))
    parts = F.when(inside, two).otherwise(F.array(_part(0, F.col("ch"), F.col("weight"), F.col("val"))))
    return _numbered(around.select("doc_id", "run_id", F.explode(parts).alias("p")).select("doc_id", "run_id", "p.*"))


def change_weight(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, run_id, delta), delta of either sign.

    A run whose weight falls to 0 or less goes. Where the runs beside what has
    gone have one symbol they become one, with the first one's value.
    """
    joined = runs.join(edits, ["doc_id", "run_id"], "left")
    left = joined.select("doc_id", "run_id", "ch", (F.col("weight") + F.coalesce("delta", F.lit(0))).alias("weight"), "val").where("weight > 0")
    order = Window.partitionBy("doc_id").orderBy("run_id")
    joins = (F.col("ch") == F.lag("ch").over(order)) & (F.col("run_id") > F.lag("run_id").over(order) + 1)
    marked = left.withColumn("new", F.when(joins, 0).otherwise(1))
    grouped = marked.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).groupBy("doc_id", "g")
    return grouped.agg(F.min("ch").alias("ch"), F.sum("weight").alias("weight"), F.min_by("val", "run_id").alias("val")).select("doc_id", (F.col("g") - 1).alias("run_id"), "ch", "weight", "val")


def set_value(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, run_id, new_val)."""
    joined = runs.join(edits.withColumn("hit", F.lit(True)), ["doc_id", "run_id"], "left")
    return joined.select("doc_id", "run_id", "ch", "weight", F.when(F.col("hit"), F.col("new_val")).otherwise(F.col("val")).alias("val"))


def push_back(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(doc_id, new_ch, new_weight, val1): joins the last run if that has the symbol, else appends one."""
    total = runs.groupBy("doc_id").agg(F.sum("weight").alias("pos"))
    placed = edits.join(total, "doc_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("val2", F.lit(None).cast("bigint"))
    return insert_run(runs, placed)


def set_key(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries (doc_id, key, val) with those of edits set: an edit's value wins."""
    both = entries.select("doc_id", "key", "val", F.lit(0).alias("age")).unionByName(edits.select("doc_id", "key", "val", F.lit(1).alias("age")))
    return both.groupBy("doc_id", "key").agg(F.max_by("val", "age").alias("val"))


def remove_key(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Entries without the keys of edits(doc_id, key)."""
    return entries.join(edits.select("doc_id", "key"), ["doc_id", "key"], "left_anti")

"""Point operators on transform rows and runs: access, rank, select, run lookup, neighbours.

Arguments are frames too, so any number of questions is one plan. Answers that
don't exist are null, but for total ranks, where an absent symbol gives 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.asof import asof
from runloom.plans import relations as R


def access(rows: DataFrame, places: DataFrame) -> DataFrame:
    """places(doc_id, bwt_pos) with ch and is_marker."""
    return places.join(rows.select("doc_id", "bwt_pos", "ch"), ["doc_id", "bwt_pos"]).withColumn("is_marker", F.col("ch").isNull())


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, ch, rle_pos, rank): how often the symbol occurs up to each of its places."""
    order = Window.partitionBy("doc_id", "ch").orderBy("rle_pos")
    return R.without_marker(rows).select("doc_id", "ch", "rle_pos", F.row_number().over(order).cast("bigint").alias("rank"))


def rank(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, ch, rle_pos) with rank: occurrences in [0, rle_pos], 0 if absent."""
    found = asof(questions, occurrences(rows), ["doc_id", "ch"], "rle_pos", ["rank"])
    return found.withColumn("rank", F.coalesce("rank", F.lit(0)))


def total_rank(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, ch, rle_pos) with total_rank: rank plus the number of smaller symbols; 0 for a symbol the text hasn't."""
    ranked = rank(rows, questions)
    joined = ranked.join(R.alphabet(rows).select("doc_id", "ch", "c_before"), ["doc_id", "ch"], "left")
    return joined.withColumn("total_rank", F.when(F.col("c_before").isNull(), F.lit(0)).otherwise(F.col("c_before") + F.col("rank"))).drop("c_before", "rank")


def select_symbol(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, ch, rank) with rle_pos of the rank-th occurrence, null past the last."""
    return questions.join(occurrences(rows), ["doc_id", "ch", "rank"], "left")


def select_total(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, t) with rle_pos of the t-th symbol of the sorted text."""
    order = Window.partitionBy("doc_id").orderBy("ch", "rle_pos")
    placed = R.without_marker(rows).select("doc_id", F.row_number().over(order).cast("bigint").alias("t"), "rle_pos")
    return questions.join(placed, ["doc_id", "t"], "left")


def run_at(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, rle_pos) with run_id and offset of the run that holds the place, null past the end."""
    starts = R.runs(rows).select("doc_id", F.col("rle_start").alias("rle_pos"), "run_id", "rle_start", "run_len")
    found = asof(questions, starts, ["doc_id"], "rle_pos", ["run_id", "rle_start", "run_len"])
    inside = F.col("rle_pos") < F.col("rle_start") + F.col("run_len")
    return found.select(*questions.columns, F.when(inside, F.col("run_id")).alias("run_id"), F.when(inside, F.col("rle_pos") - F.col("rle_start")).alias("offset"))


def run_of_rank(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, ch, rank) with run_id and offset of the run of ch that holds its rank-th occurrence, null past the last."""
    per_symbol = Window.partitionBy("doc_id", "ch").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = R.runs(rows).withColumn("upto", F.sum("run_len").over(per_symbol)).withColumn("rank", F.col("upto") - F.col("run_len") + 1)
    found = asof(questions, summed.select("doc_id", "ch", "rank", "run_id", F.col("rank").alias("first"), "upto"), ["doc_id", "ch"], "rank", ["run_id", "first", "upto"])
    inside = F.col("rank") <= F.col("upto")
    return found.select(*questions.columns, F.when(inside, F.col("run_id")).alias("run_id"), F.when(inside, F.col("rank") - F.col("first")).alias("offset"))


def symbol_of_sorted_place(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, t) with the symbol at 1-based place t of the sorted text, null past its end."""
    counts = R.alphabet(rows).select("doc_id", (F.col("c_before") + 1).alias("t"), "ch", (F.col("c_before") + F.col("occ")).alias("upto"))
    found = asof(questions, counts, ["doc_id"], "t", ["ch", "upto"])
    return found.withColumn("ch", F.when(F.col("t") <= F.col("upto"), F.col("ch"))).drop("upto")


def symbol_at_most(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, x) with found: the largest symbol of the text that is x or less."""
    symbols = R.alphabet(rows).select("doc_id", F.col("ch").alias("x"), F.col("ch").alias("found"))
    return asof(questions, symbols, ["doc_id"], "x", ["found"])


def previous_run_of(rows: DataFrame, symbol: int) -> DataFrame:
    """(doc_id, run_id, pred_run): the last run of the symbol strictly before each run."""
    before = R.by_run().rowsBetween(Window.unboundedPreceding, -1)
    return R.runs(rows).select("doc_id", "run_id", F.last(F.when(F.col("ch") == symbol, F.col("run_id")), ignorenulls=True).over(before).alias("pred_run"))


def previous_runs(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(doc_id, ch, run_id) with pred_run: the last run of ch strictly before run_id, null if there is none."""
    found = R.runs(rows).select("doc_id", "ch", "run_id", F.col("run_id").alias("pred_run"))
    return asof(questions, found, ["doc_id", "ch"], "run_id", ["pred_run"], strict=True)


def run_neighbours(rows: DataFrame) -> DataFrame:
    """(doc_id, run_id, run_no_in_ch, prev_run, next_run, prev_same, next_same): neighbours in text order and among runs of one symbol."""
    same = Window.partitionBy("doc_id", "ch").orderBy("run_id")
    return R.runs(rows).select(
        "doc_id",
        "run_id",
        F.row_number().over(same).cast("bigint").alias("run_no_in_ch"),
        F.lag("run_id").over(R.by_run()).alias("prev_run"),
        F.lead("run_id").over(R.by_run()).alias("next_run"),
        F.lag("run_id").over(same).alias("prev_same"),
        F.lead("run_id").over(same).alias("next_same"),
    )


def alphabet_neighbours(rows: DataFrame) -> DataFrame:
    """(doc_id, ch, first_ch, prev_ch, next_ch)."""
    order = Window.partitionBy("doc_id").orderBy("ch")
    counts = R.alphabet(rows)
    return counts.select("doc_id", "ch", F.first("ch").over(order).alias("first_ch"), F.lag("ch").over(order).alias("prev_ch"), F.lead("ch").over(order).alias("next_ch"))


def marker_samples(rows: DataFrame) -> DataFrame:
    """(doc_id, em_pos, prev_txt, next_txt): text positions of the rows beside the end marker's."""
    beside = rows.select("doc_id", "bwt_pos", "ch", F.lag("txt_pos").over(R.by_row()).alias("prev_txt"), F.lead("txt_pos").over(R.by_row()).alias("next_txt"))
    return beside.where("ch is null").select("doc_id", F.col("bwt_pos").alias("em_pos"), "prev_txt", "next_txt")


def range_weight(runs: DataFrame, first: int, end: int) -> DataFrame:
    """(doc_id, weight): summed length of the runs with first <= run_id < end."""
    inside = (F.col("run_id") >= first) & (F.col("run_id") < end)
    return runs.groupBy("doc_id").agg(F.sum(F.when(inside, F.col("run_len")).otherwise(F.lit(0))).alias("weight"))

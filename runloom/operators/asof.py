"""As-of joins without a join: queries and facts in one ordered window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(queries: DataFrame, facts: DataFrame, by: Sequence[str], at: str, values: Sequence[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """queries with the values of the nearest fact at or before (forward: at or after) their `at`; nulls if there is none.

    strict leaves out facts at the same place. Both frames have the columns
    `by` and `at`. One shuffle on `by`, one sort, no pairs of rows.
    """
    columns = queries.columns
    got = F.struct(*[F.col(v).alias(v) for v in values])
    kind = facts.select(got.alias("v")).schema["v"].dataType
    query_side = int(forward == strict)  # which comes second at one place
    query = queries.select(*by, F.col(at).alias("_at"), F.lit(query_side).alias("_side"), F.struct(*columns).alias("_q"), F.lit(None).cast(kind).alias("_v"))
    fact_side = F.lit(1 - query_side)
    fact = facts.select(*by, F.col(at).alias("_at"), fact_side.alias("_side"), F.lit(None).cast(queries.select(F.struct(*columns).alias("q")).schema["q"].dataType).alias("_q"), got.alias("_v"))
    order = Window.partitionBy(*by).orderBy("_at", "_side")
    near = F.first("_v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = query.unionByName(fact).withColumn("_near", near).where("_q is not null")
    return found.select("_q.*", *[F.col(f"_near.{v}").alias(v) for v in values])

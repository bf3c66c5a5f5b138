"""Running values along a key's rows in two levels, so that a long key isn't one task's.

A key's rows are cut into buckets by a rising function of their order (minutes of a time, ranges of a position). Each
bucket is scanned apart; the buckets' own values, a line each, are scanned once more, and what lies before a bucket is
carried into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Span of a time bucket.
BUCKET_MS = 600_000

HOW = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def time_bucket(column: str | Column, width: int = BUCKET_MS) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / width)


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, tuple[Column, str]], own: bool = False) -> DataFrame:
    """``df`` with, by new name, the max, sum or last known (not null) of a value over the rows of the key before it, and its own if ``own``.

    The bucket mustn't fall along the order. Rows before which there is nothing get null (sum: 0).
    """
    b = df.withColumn("_bucket", bucket)
    b = b.withColumns({f"_v_{name}": value for name, (value, _) in values.items()})
    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))
    agg = [(F.max_by(f"_v_{n}", known(n)) if how == "last" else HOW[how](f"_v_{n}")).alias(f"_c_{n}") for n, (_, how) in values.items()]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = b.groupBy(*keys, "_bucket").agg(*agg).select(*keys, "_bucket", *(HOW[how](f"_c_{n}").over(before).alias(f"_c_{n}") for n, (_, how) in values.items()))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    scanned = b.withColumns({f"_w_{n}": HOW[how](f"_v_{n}").over(within) for n, (_, how) in values.items()})
    met = scanned.join(carried.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_k_bucket"), *(f"_c_{n}" for n in values)), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_k_bucket")])

    def joined(n: str, how: str) -> Column:
        w, c = F.col(f"_w_{n}"), F.col(f"_c_{n}")
        if how == "max":
            return F.greatest(w, c)  # skips nulls
        return F.coalesce(w, c) if how == "last" else F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))

    return met.select(*df.columns, *(joined(n, how).alias(n) for n, (_, how) in values.items()))

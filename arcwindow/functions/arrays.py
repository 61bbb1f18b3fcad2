"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    An expression that sits inside a lambda is evaluated again for every element;
    a lambda variable is not. Binding through a one-element array keeps the
    surrounding higher-order functions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def index_of(values: Column) -> Column:
    """``[0, 1, .. n-1]`` for an array of n elements (empty for an empty one)."""
    return F.transform(values, lambda _, i: i)


def all_distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def run_lengths(values: Column) -> Column:
    """``array<struct<value, n>>``: how often each non-null value occurs.

    Sorting makes equal values neighbours, so the cost is n log n whatever the
    number of distinct values.
    """

    def count_runs(ordered: Column) -> Column:
        starts = F.filter(
            index_of(ordered),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("value"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - start)
                    .cast("bigint")
                    .alias("n"),
                ),
            ),
        )

    return let(F.sort_array(F.array_compact(values)), count_runs)


def where_here(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays where it is written.

    The optimizer moves an ordinary filter below the projections it reads from and puts
    their expressions into it. For a test on parsed or matched arrays that means parsing
    and matching again, once per mention. A generator of one row or none is not moved.
    """
    keep = F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_keep")
    return df.select("*", keep).where("_keep IS NOT NULL").drop("_keep")

"""Small building blocks for native array programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>") if values else F.array().cast("array<string>")


def merge_adjacent(
    parts: Column,
    fits: Callable[[Column, Column], Column],
    separator: str = " ",
    tidy: Callable[[Column], Column] = lambda c: c,
) -> Column:
    """Left-to-right: append a part to the open one while ``fits(open, part)``, else open a new one."""
    start = F.struct(strings().alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = tidy(F.concat(acc["open"], F.lit(separator), part))
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), part.alias("open")))
            .when(fits(acc["open"], part), F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), part.alias("open")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(parts, start, step, finish)


def slices(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters."""
    last = F.floor((F.length(text) - 1) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size))
    )


def pick(values: Column, positions: Column) -> Column:
    """Elements of ``values`` at zero-based ``positions``."""
    return F.transform(positions, lambda i: F.get(values, i))

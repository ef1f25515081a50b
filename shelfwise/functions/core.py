"""Small building blocks shared by every operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

AsOf = datetime | str | Column


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(as_of: AsOf) -> Column:
    """``as_of`` as a zone-free timestamp, so a result never depends on the session time zone."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def days(n: int | float) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding in plain double arithmetic.

    A nudge of 1e-7 units absorbs binary noise, so 12.285000000000002 and
    12.284999999999998 round alike. ``value`` appears once, so nested roundings
    stay small and inside whole-stage codegen, with no BigDecimal per row.
    """
    scale = float(10**digits)
    return F.floor(value * scale + F.lit(0.5000001)) / F.lit(scale)


def positive(value: Column) -> Column:
    """``value`` when above zero, else null; mentions ``value`` once so heavy expressions are not repeated."""
    return F.nullif(F.greatest(value, F.lit(0.0)), F.lit(0.0))


def exact_sum(value: Column, digits: int = 2) -> Column:
    """Order-independent sum of a value that carries ``digits`` decimals (integer arithmetic inside)."""
    scale = float(10**digits)
    units = F.floor(value * scale + F.lit(0.5000001)).cast("bigint")
    return F.sum(units).cast("double") / F.lit(scale)


def exact_avg(value: Column, digits: int = 2) -> Column:
    return F.try_divide(exact_sum(value, digits), F.count(value).cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, evaluated once a row however often it is used.

    Spark puts an expression in place of each use of a column and shares it only where no
    branch is in between. A generator ends that: what comes out of it is a value.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(F.length(trimmed) > 0, trimmed)


def first_reason(*rules: tuple[Column, Column | str]) -> Column:
    """Reason of the first rule whose condition holds; null when every rule passes."""
    return F.coalesce(
        *[F.when(cond, reason if isinstance(reason, Column) else F.lit(reason)) for cond, reason in rules]
    )

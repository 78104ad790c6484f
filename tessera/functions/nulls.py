"""Null-aware expressions. Inside Spark a missing value is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float or double column becomes NULL."""
    kinds = (T.FloatType, T.DoubleType)
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).cast(f.dataType).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema.fields])


def is_true(condition: Column) -> Column:
    """The condition, with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def not_in(c: str | Column, values: Iterable) -> Column:
    """Not one of values; a missing value is not, and stays."""
    return ~is_true(col(c).isin(list(values)))


def _over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def safe_corr(x: str | Column, y: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson r over rows with both values; NULL if either is constant or under two rows."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    scale = _over(F.stddev_pop(a), over) * _over(F.stddev_pop(b), over)
    return F.try_divide(_over(F.covar_pop(a, b), over), F.nullif(scale, F.lit(0.0)))


def pair_count(x: str | Column, y: str | Column) -> Column:
    return F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1))


def zscore(c: str | Column, over: WindowSpec, ddof: int = 0) -> Column:
    """(value - mean) / sd within the window; NULL where the sd is 0 or missing."""
    sd = F.stddev_pop(col(c)).over(over) if ddof == 0 else F.stddev_samp(col(c)).over(over)
    return F.try_divide(col(c) - F.avg(col(c)).over(over), F.nullif(sd, F.lit(0.0)))


def flag(c: str | Column) -> Column:
    """A boolean written as text: true, 1, 1.0, yes or y, in any case."""
    return is_true(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "1.0", "yes", "y"))


def number(c: str | Column) -> Column:
    """Text to double; what is no number becomes NULL."""
    return col(c).try_cast("double")

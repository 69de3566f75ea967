"""Numeric expressions: clean-up, safe statistics and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_fractional_type(t: T.DataType) -> bool:
    return isinstance(t, (T.FractionalType, T.DecimalType))


def is_time_type(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested_type(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def observed(name: str, t: T.DataType) -> Column:
    """The column with NaN counted as missing (NaN is the missing marker of the data model)."""
    c = quoted(name)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(name: str, t: T.DataType) -> Column:
    return observed(name, t).cast("double")


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population value; null below 3 rows."""
    return F.when(
        n >= 3, g1 * F.sqrt(n.cast("double") * (n - 1)) / (n - 2)
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def zero_if_infinite(c: Column) -> Column:
    """Infinite and missing numbers become 0."""
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == inf), F.lit(0.0)).otherwise(c)


def float_text(c: Column) -> Column:
    """Shortest text of a double in the ``str(float)`` style (sci only >=1e16 or <1e-4)."""
    plain = c.cast("string")
    size = F.abs(c)
    digits = F.call_function("format_number", c, F.lit("0.0" + "#" * 17))
    digits = F.replace(digits, F.lit(","), F.lit(""))
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([^E]*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    sci = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.translate(exponent, "-", ""), 2, "0"))
    small = (size > 0) & (size < 1e-3)
    return (
        F.when(F.isnan(c), "nan")
        .when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        .when(((size >= 1e7) & (size < 1e16)) | (small & (size >= 1e-4)), digits)
        .when((size >= 1e16) | small, sci)
        .otherwise(plain)
    )


def value_text(c: Column, t: T.DataType) -> Column:
    """Text form of any cell, used as the class label of an encoded column."""
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return float_text(c.cast("double"))
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if is_nested_type(t):
        return F.to_json(c)
    return c.cast("string")

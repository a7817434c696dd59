"""Amounts in minor units and their display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def minor_units(c: Column, numeric: bool, scale: int = 100) -> Column:
    """Signed minor units, half to even; what is no number gives 0. Brackets make an amount negative, other signs are dropped.

    Numeric columns never pass through text, where large values would turn into exponents.
    """
    if numeric:
        value = c.cast("double")
    else:
        bare = F.regexp_replace(c, r"[^0-9.()\-]", "")
        value = F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast("double")
    return F.rint(F.coalesce(value, F.lit(0.0)) * scale).cast("long")


def rupees(minor: Column) -> Column:
    """'Rs 12,34,567.89 (12.35 lakh)': Indian grouping, with lakh or crore beyond a hundred thousand or ten million; '-' for null."""
    size = F.abs(minor)
    whole = F.expr("cast(0 as bigint)") + F.floor(size / 100)
    grouped = F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")
    sign = F.when(minor < 0, "-").otherwise("")
    plain = F.concat(F.lit("Rs "), sign, grouped, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    short = lambda unit, name: F.concat(F.lit(" ("), sign, F.format_string("%.2f", size / float(100 * unit)), F.lit(f" {name})"))
    return F.when(minor.isNull(), "-").otherwise(F.concat(plain, F.when(size >= 1_000_000_000, short(10_000_000, "crore")).when(size >= 10_000_000, short(100_000, "lakh")).otherwise("")))


def with_display(df: DataFrame) -> DataFrame:
    """df with a *_display field beside every whole *_minor field, also within structs, arrays and values of maps, and names that end in it replaced."""
    return df.select(*_displayed(df.schema, lambda n: F.col(f"`{n}`")))


def _displayed(fields: T.StructType, of: Callable[[str], Column]) -> list[Column]:
    shown = {f.name: f"{f.name.removesuffix('_minor')}_display" for f in fields if f.name.endswith("_minor") and isinstance(f.dataType, T.IntegerType | T.LongType)}
    out = []
    for f in fields:
        if f.name not in shown.values():
            out.append(_inner(of(f.name), f.dataType).alias(f.name))
        if f.name in shown:
            out.append(rupees(of(f.name)).alias(shown[f.name]))
    return out


def _inner(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*_displayed(kind, c.getField)))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.AtomicType):
        return F.transform(c, lambda x: _inner(x, kind.elementType))
    if isinstance(kind, T.MapType) and not isinstance(kind.valueType, T.AtomicType):
        return F.transform_values(c, lambda _, x: _inner(x, kind.valueType))
    return c

"""Column-expression builders shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str) -> Column:
    """Column reference safe for names with spaces, dots or symbols."""
    return F.col(f"`{name}`")


def r6(c: Column) -> Column:
    """Round to 6 places for comparisons; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI division by zero would abort the whole query)."""
    return F.when(den != 0, num / den)


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL comparison counts as false (as NaN comparisons do)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def right_closed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edges[i], edges[i+1]]; NULL outside every bin or for NULL input."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = c > F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (c <= F.lit(float(hi)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def left_closed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin [edges[i], edges[i+1]); NULL outside."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = c >= F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (c < F.lit(float(hi)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def text_map(c: Column, mapping: Mapping[str, int], default: int = 0) -> Column:
    """Fixed text -> integer map; unmapped and NULL give ``default``."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default)).cast("int")


def clip(c: Column, lo, hi) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, lo_c), hi_c))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, NUMERIC_TYPES)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f) and f.name not in exclude]


def type_class(field: T.StructField) -> str:
    """The dtype class a row-oriented loader reports for this column."""
    dt = field.dataType
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "object"


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

"""Text keys as column expressions. Missing text is the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without Unicode white space at either end; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def address_key(c: Column) -> Column:
    """White space and brackets, commas and full stops go; long province names become short, to a fixpoint."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s()\[\]{},.]", "")
    for long, short in (("충청남도", "충남"), ("충청북도", "충북"), ("대전(?:광역시)+", "대전"), ("세종(?:특별자치시)+", "세종")):
        out = F.regexp_replace(out, long, short)
    return out


def settled(df: DataFrame) -> DataFrame:
    """df, computed once for each row: filters above it use its columns, and don't repeat their expressions.

    The optimizer copies a column's whole expression into every filter that it pushes below it, which makes
    chains of patterns run many times; it doesn't push through a generator."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))

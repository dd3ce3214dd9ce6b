"""Check of a committed master: everything derived is computed again and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pricing, reconcile
from .feed import FUELS, TEXTS

#: What `pricing.priced` derives from a row's own columns.
DERIVED = (
    "smart_discount", *(f"adj_{c}" for c in FUELS), "total_price", "region_rate", "region_discount", "regional_total", "sort_key", "unit_price_with", "unit_price_without", "fuel_total_text",
)
BASE = ("row_num", *TEXTS, *FUELS, "ultra_flag", "currency_apply", "smart_excluded")


def problems(stored: DataFrame, params: pricing.Params) -> DataFrame:
    """(what, n): for each derived column the rows that differ from what follows from their own columns, nulls included; for `rank` those that
    differ from the rank of the recomputed total; for `position` 1 if the places aren't 1 to n, each once; for `order` the rows that
    don't lie where rows of their rank lie.

    Places are proved dense by their count, least, most, sum and sum of squares, without a sort. Two passes over the rows and one
    join on the total."""
    p = pricing.priced(stored.select(*BASE, "rank", "position", *(F.col(c).alias(f"stored_{c}") for c in DERIVED)), params)
    ranks = reconcile.ranks_of(p.select("regional_total"), "regional_total", "want")
    ties = p.where("regional_total is not null").groupBy("regional_total").agg(F.count("*").alias("ties"))
    p = p.join(ranks.join(ties, "regional_total"), "regional_total", "left")
    n, at = F.count("*").cast("decimal(38,0)"), F.col("position").cast("decimal(38,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    dense = (F.count("position") == F.count("*")) & (F.coalesce(F.min("position"), F.lit(1)) == 1) & (F.coalesce(F.max("position"), F.lit(0)) == F.count("*"))
    dense = dense & (2 * F.coalesce(F.sum(at), F.lit(0)) == whole(n * (n + 1))) & (6 * F.coalesce(F.sum(whole(at * at)), F.lit(0)) == whole(whole(n * (n + 1)) * (2 * n + 1)))
    misplaced = F.when(F.col("want").isNotNull(), ~F.col("position").between(F.col("want"), F.col("want") + F.col("ties") - 1))
    counts: dict[str, Column] = {c: F.count_if(~F.col(c).eqNullSafe(F.col(f"stored_{c}"))) for c in DERIVED}
    counts |= {"rank": F.count_if(~F.col("rank").eqNullSafe(F.col("want"))), "position": F.when(dense, 0).otherwise(1).cast("long"), "order": F.count_if(F.coalesce(misplaced, F.lit(False)))}
    one = p.agg(*(c.alias(f"n_{k}") for k, c in counts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("what"), F.col(f"n_{k}").alias("n")) for k in counts))))


def check(stored: DataFrame, params: pricing.Params) -> None:
    """An error that names what differs."""
    if found := problems(stored, params).where("n > 0").collect():  # some fifteen rows at most
        raise RuntimeError(f"the master isn't what follows from its rows: {', '.join(f'{r['what']} in {r['n']}' for r in found)}")

"""Exact-decimal prices: adjusted prices, totals, regional discounts, unit prices, texts and the sort key."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import fixed_decimal, lenient_int, with_ratio_text
from ..functions.region import REGIONS
from ..functions.text import trim
from ..sources.scratch import kept
from .feed import FUELS

#: Who gets the smart discount, fuel labels in order of the text, and the key of rows without a total.
SMART = ("현대오일뱅크", "직영")
LABELS = {"gasoline": "휘발유", "premium": "고급유", "diesel": "경유"}
LAST = 10**15
#: Names of the input cells.
INPUTS = (*(f"quantity_{c}" for c in FUELS), *(f"average_{c}" for c in FUELS), "smart_discount")


@dataclass(frozen=True)
class Params:
    """Quantities, average prices, smart discount (negative) and regional rates."""

    quantity: dict = field(default_factory=lambda: {"gasoline": Decimal(30), "premium": Decimal(0), "diesel": Decimal(20)})
    average: dict = field(default_factory=lambda: {"gasoline": 1700, "premium": 1900, "diesel": 1500})
    smart_discount: Decimal = Decimal(-25)
    rates: dict = field(default_factory=lambda: dict.fromkeys(REGIONS, Decimal("0.07")))

    def total(self) -> Decimal:
        return sum(self.quantity.values(), Decimal(0))


def load_params(inputs: DataFrame, rates: DataFrame) -> Params:
    """Parameters from text cells: inputs (name, value) as in INPUTS, rates (row_num, region, rate). A blank quantity or
    discount is zero, a blank average and any text that is no number an error. Of a region's rates the last one that isn't blank counts,
    labels other than the seven are ignored."""
    value, bad = fixed_decimal(F.col("value"))
    cells = {r["name"]: r for r in inputs.where(F.col("name").isin(*INPUTS)).select("name", "value", value.alias("exact"), bad.alias("bad"), lenient_int(F.col("value")).alias("whole")).collect()}  # seven rows
    for name in INPUTS:
        r = cells.get(name)
        if r is not None and r["bad"] or name.startswith("average") and (r is None or r["whole"] is None):
            raise ValueError(f"the input {name} is {None if r is None else r['value']!r}")
    number = lambda name: cells[name]["exact"] or Decimal(0) if name in cells else Decimal(0)
    rate, bad = fixed_decimal(F.col("rate"))
    known = rates.select("row_num", trim(F.col("region")).alias("region"), "rate", rate.alias("exact"), bad.alias("bad")).where("region <> ''")
    if (r := known.where("bad").orderBy("row_num").first()) is not None:
        raise ValueError(f"the rate of {r['region']} is {r['rate']!r}")
    last = last_rates(rates).collect()  # seven rows at most
    return Params({c: number(f"quantity_{c}") for c in FUELS}, {c: cells[f"average_{c}"]["whole"] for c in FUELS}, number("smart_discount"), {r["region"]: r["rate"] for r in last})


def last_rates(rates: DataFrame) -> DataFrame:
    """(region, rate): of each region's rates the last one that isn't blank."""
    rate, _ = fixed_decimal(F.col("rate"))
    known = rates.select("row_num", trim(F.col("region")).alias("region"), rate.alias("rate"))
    return known.where(F.col("region").isin(*REGIONS) & F.col("rate").isNotNull()).groupBy("region").agg(F.max_by("rate", "row_num").alias("rate"))


def dec(value: object, kind: str) -> Column:
    return F.lit(str(value)).cast(kind)


def priced(master: DataFrame, params: Params) -> DataFrame:
    """All derived columns of each row; `missing_rate` marks a row whose region has no rate, which is an error."""
    spark = master.sparkSession
    # at most a row for each region
    rates = spark.createDataFrame([(k, str(v)) for k, v in params.rates.items() if v is not None], "region string, rate_text string").select(F.col("region").alias("rate_region"), F.col("rate_text").cast("decimal(8,6)").alias("rate"))
    d = master.join(F.broadcast(rates), trim(F.col("region")) == F.col("rate_region"), "left").drop("rate_region")
    eligible = F.lit(True)
    for part in SMART:
        eligible = eligible & F.col("name").contains(part)
    excluded = F.coalesce(F.col("smart_excluded"), F.lit(False)) if "smart_excluded" in master.columns else F.lit(False)
    d = d.withColumn("smart_discount", F.when(~excluded & eligible, dec(params.smart_discount, "decimal(12,6)")).otherwise(dec(0, "decimal(12,6)")))
    d = d.withColumns({f"adj_{c}": (F.col(c).cast("decimal(10,0)") + F.col("smart_discount")).cast("decimal(13,6)") for c in FUELS})
    parts = {c: dec(0, "decimal(26,12)") if params.quantity[c] == 0 else (dec(params.quantity[c], "decimal(12,6)") * F.col(f"adj_{c}")).cast("decimal(26,12)") for c in FUELS}
    whole = params.total()
    total = (parts["gasoline"] + parts["premium"] + parts["diesel"]).cast("decimal(28,12)") if whole else F.lit(None).cast("decimal(28,12)")
    d = d.withColumn("total_price", total)
    applies = F.upper(trim(F.col("currency_apply"))) == "Y"
    # shown only where there is a total; the order of rows uses `rate` itself
    d = d.withColumn("missing_rate", applies & F.col("rate").isNull()).withColumn("rate", F.when(applies, F.col("rate")).otherwise(dec(0, "decimal(8,6)")))
    d = d.withColumn("region_rate", F.when(F.col("total_price").isNotNull(), F.col("rate")))
    exact = (F.col("total_price") * F.col("rate")).cast("decimal(38,18)")
    d = d.withColumn("region_discount", F.when(exact >= 0, F.floor(exact)).otherwise(F.ceil(exact)).cast("decimal(20,0)"))
    d = d.withColumn("regional_total", (F.col("total_price") - F.col("region_discount")).cast("decimal(28,12)"))
    d = d.withColumn("sort_key", F.coalesce(F.col("regional_total"), dec(LAST, "decimal(28,12)")))
    d = d.withColumns({f"order_{c}": (F.col(f"adj_{c}") * (1 - F.col("rate"))).cast("decimal(24,12)") for c in FUELS})
    unit = lambda c: F.col(c).cast("double") / float(whole) if whole else F.lit(None).cast("double")
    d = d.withColumn("unit_price_with", unit("regional_total")).withColumn("unit_price_without", unit("total_price"))
    texts = [F.concat(F.lit(f"{LABELS[c]} "), F.format_number(F.floor(parts[c] + F.lit(Decimal("0.5"))), 0), F.lit("원")) for c in FUELS if params.quantity[c] != 0]
    return d.withColumn("fuel_total_text", F.when(F.col("total_price").isNotNull(), F.concat_ws(" / ", *texts)))



def with_unit_texts(priced_rows: DataFrame, params: Params) -> DataFrame:
    """The unit prices' exact texts, null without a total or quantities. Each different total is divided once, wherever it stands."""
    whole = params.total()
    totals = {"unit_text_with": "regional_total", "unit_text_without": "total_price"}
    if not whole:
        return priced_rows.withColumns({name: F.lit(None).cast("string") for name in totals})
    each = priced_rows.select(F.explode(F.array(*totals.values())).alias("total__")).where("total__ is not null").distinct()
    # both as whole numbers of 10 ** -12
    above = (F.col("total__") * F.lit(Decimal(10**12))).cast("decimal(38,0)")
    texts = kept(with_ratio_text(each, "text__", above, F.lit(Decimal(int(whole * 10**12))).cast("decimal(38,0)")), "unit-texts")
    d = priced_rows
    for name, total in totals.items():
        own = texts.select(F.col("total__").alias(f"{name}__"), F.col("text__").alias(name))
        d = d.join(own, F.col(total) == F.col(f"{name}__"), "left").drop(f"{name}__")
    return d


def order_keys() -> list[Column]:
    """After the total: rate-adjusted prices, nulls last, then text in byte order, then the order before, new rows last."""
    return [*(F.col(f"order_{c}").asc_nulls_last() for c in FUELS), F.col("region"), F.col("name"), F.col("address"), F.col("row_num").asc_nulls_last()]


def input_summary(inputs: DataFrame) -> DataFrame:
    """One row of the input cells (name, value): quantities together and the two weighted averages, of whole numbers, and the
    first error. The second average divides by the sum of gasoline and premium as the first does, which is an error if
    that is zero though premium and diesel are not; an empty cell is one too."""
    cell = lambda name: F.max(F.when(F.col("name") == name, lenient_int(F.col("value")))).cast("long").alias(name)
    names = INPUTS[:-1]
    d = inputs.agg(*map(cell, names))
    q, a = ({c: F.col(f"{k}_{c}") for c in FUELS} for k in ("quantity", "average"))
    error = F.lit(None).cast("string")
    for name in reversed(names):
        error = F.when(F.col(name).isNull(), f"{name} is empty").otherwise(error)
    low, rest = q["gasoline"] + q["premium"], q["premium"] + q["diesel"]
    error = F.coalesce(error, F.when((low == 0) & (rest != 0), "nothing to divide by"))
    ratio = lambda above: F.try_divide(above.cast("double"), low.cast("double"))
    return d.select(
        (low + q["diesel"]).cast("double").alias("quantity"), ratio(q["gasoline"] * a["gasoline"] + q["premium"] * a["premium"]).alias("average_with_premium"),
        F.when(rest != 0, ratio(q["gasoline"] * a["gasoline"] + q["premium"] * a["diesel"])).alias("average_with_diesel"), error.alias("error"),
    )

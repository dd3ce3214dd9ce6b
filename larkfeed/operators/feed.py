"""The published feed: from text columns to typed rows, with every rule's failures as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import feed_price
from ..functions.region import strict
from ..functions.text import address_key, settled, trim

FUELS = ("gasoline", "premium", "diesel")
TEXTS = ("region", "name", "address", "brand", "self_yn")
SERVICES = ("셀프", "일반")


#: Columns of the published feed and of the master, by name and type.
FEED_COLUMNS = {"row_num": "integral", **dict.fromkeys((*TEXTS, *FUELS), "string")}
MASTER_COLUMNS = {"row_num": "integral", **dict.fromkeys((*TEXTS, "ultra_flag", "currency_apply"), "string"), **dict.fromkeys(FUELS, "integral")}


def expect(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    """df, if it has the columns in their types; else an error before any row is read. Further columns are ignored."""
    have = dict(df.dtypes)
    for name, kind in columns.items():
        if name not in have:
            raise ValueError(f"{what}: the column {name} is missing")
        if not (have[name] in ("int", "bigint", "smallint", "tinyint") if kind == "integral" else have[name] == kind):
            raise ValueError(f"{what}: the column {name} is {have[name]}, not {kind}")
    return df


def checked(raw: DataFrame) -> DataFrame:
    """Each row that isn't blank with its key, region, prices and `error`, the first rule it breaks."""
    expect(raw, FEED_COLUMNS, "feed")
    d = raw.select("row_num", *(trim(F.col(c)).alias(c) for c in TEXTS), *(trim(F.col(c)).alias(f"{c}_text") for c in FUELS))
    blank = F.concat(*(F.col(c) for c in d.columns if c not in ("row_num", "address")))
    d = settled(d).where((F.col("address") != "") | (blank != ""))
    prices = {c: feed_price(F.col(f"{c}_text")) for c in FUELS}
    region, state = strict(F.col("region"), F.col("address"))
    d = d.select("row_num", *TEXTS, region.alias("target"), state.alias("state"), address_key(F.col("address")).alias("address_key"), *(p[0].alias(c) for c, p in prices.items()), *(p[1].alias(f"{c}_bad") for c, p in prices.items()))
    d = settled(d)
    known = F.col("state") != "dropped"
    # a row's errors in the order in which its cells are read
    error = F.when(F.col("address") == "", "no address").when(F.col("diesel_bad"), "bad diesel").when(F.col("gasoline_bad"), "bad gasoline").when(F.col("name") == "", "no name")
    error = error.when(F.col("premium_bad"), "bad premium").when(~F.col("self_yn").isin(*SERVICES), "bad service")
    return d.withColumn("error", error.when(known & (F.col("state") != "ok"), F.concat(F.lit("region: "), F.col("state"))))


def typed(checked_rows: DataFrame, *more: str) -> DataFrame:
    """The target regions' rows, with `more` of their columns; the region is its canonical label."""
    d = checked_rows.where("error is null and state = 'ok'")
    return d.select("address_key", F.col("target").alias("region"), "name", "address", "brand", "self_yn", *FUELS, *more)


def once(df: DataFrame, key: str, row: str = "row_num") -> DataFrame:
    """The first row of each key, with the times that the key occurs and its last row's number. The same deal of rows by the key
    serves a join on it afterwards."""
    first = F.struct(row, *(c for c in df.columns if c not in (key, row)))
    return df.groupBy(key).agg(F.min(first).alias("first"), F.count("*").alias("times"), F.max(row).alias("last_row")).select(key, "first.*", "times", "last_row")


def duplicate_keys(df: DataFrame, *keys: str, row: str | None = None) -> DataFrame:
    """Keys that occur more than once, with their count and first and last row numbers."""
    more = [F.min(row).alias("first_row"), F.max(row).alias("last_row")] if row else []
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *more).where("n > 1")

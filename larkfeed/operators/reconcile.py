"""Feed against master: one full outer join on the address key, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_key, settled, squeeze, trim
from ..sources.scratch import kept
from .feed import FUELS, MASTER_COLUMNS, TEXTS, expect, once

#: Reasons in their order, and those of rows on one side only.
REASONS = ("가격변동", "지역정정", "상호변경", "상표변경", "셀프여부변경")
NEW, CLOSED = "신규", "폐업"
CARRIED = ("ultra_flag", "currency_apply")
#: The manual override that takes the smart discount from a row; it stays with the row, and new rows have none.
EXCLUDED = "smart_excluded"


def keyed(master: DataFrame) -> DataFrame:
    """Master rows that aren't blank, with their key (null where the address is blank) and prices above zero or null."""
    expect(master, MASTER_COLUMNS, "master")
    if EXCLUDED not in master.columns:
        master = master.withColumn(EXCLUDED, F.lit(False))
    master = master.select(*MASTER_COLUMNS, F.coalesce(EXCLUDED, F.lit(False)).alias(EXCLUDED))
    d = settled(master.withColumns({c: trim(F.col(c)) for c in TEXTS})).where("region <> '' or name <> '' or address <> ''")
    d = d.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in FUELS})
    return settled(d.withColumn("address_key", F.when(F.col("address") != "", address_key(F.col("address")))))


def compared(feed: DataFrame, master: DataFrame) -> DataFrame:
    """Both sides of each key as new_* and old_*, with kind (matched, new, closed, unaddressed) and reason."""
    return compared_keyed(feed, keyed(master))


def _times(df: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in ("times", "last_row") if c in df.columns]


def _old_side(old: DataFrame) -> DataFrame:
    return old.select("address_key", "row_num", *(F.col(c).alias(f"old_{c}") for c in (*TEXTS, *FUELS)), *CARRIED, EXCLUDED, *_times(old, "master"), F.lit(True).alias("in_master"))


def compared_keyed(feed: DataFrame, old: DataFrame) -> DataFrame:
    """The same for a master that has its keys already, so that one that is kept by buckets of them isn't dealt anew. Columns of `once`,
    where there are any, come along as feed_* and master_*."""
    row = [F.col("row_num").alias("feed_row")] if "row_num" in feed.columns else []
    new = feed.select("address_key", *(F.col(c).alias(f"new_{c}") for c in (*TEXTS, *FUELS)), *row, *_times(feed, "feed"), F.lit(True).alias("in_feed"))
    return explained(new.join(_old_side(old), "address_key", "full_outer"))


def explained(d: DataFrame) -> DataFrame:
    """Joined rows with their kind and reason."""
    kind = F.when(F.col("in_feed") & F.col("in_master"), "matched").when(F.col("in_feed"), "new").when(F.col("address_key").isNull(), "unaddressed").otherwise("closed")
    priced = ~F.lit(True)
    for c in FUELS:
        priced = priced | ~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    tests = (priced, *(F.col(f"new_{c}") != F.col(f"old_{c}") for c in ("region", "name", "brand")), F.col("new_self_yn") != squeeze(F.col("old_self_yn")))
    reason = F.concat_ws(", ", *(F.when(t, r) for t, r in zip(tests, REASONS, strict=True)))
    return d.withColumn("kind", kind).withColumn("reason", F.when(F.col("kind") == "matched", reason).when(F.col("kind") == "new", NEW).when(F.col("kind") == "closed", CLOSED).otherwise(""))


def stored_compared(feed: DataFrame, addressed: DataFrame, unaddressed: DataFrame, buckets: int) -> DataFrame:
    """The same for a master kept in two tables: rows with a key, in so many buckets of it, and the others, which match nothing and are
    many rows of no key. The feed is dealt to the buckets, and the master lies where it is, also while keys are counted."""
    d = compared_keyed(once(feed.repartition(buckets, "address_key"), "address_key"), once(addressed, "address_key"))
    rest = _old_side(unaddressed).withColumns({"kind": F.lit("unaddressed"), "reason": F.lit("")})
    return d.unionByName(rest, allowMissingColumns=True)


def change_log(pairs: DataFrame) -> DataFrame:
    """Changed, new and closed rows: feed text where there is a feed row, both prices and their differences."""
    d = pairs.where("reason <> ''")
    shown = [F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in ("region", "name", "address")]
    prices = [x for c in FUELS for x in (F.col(f"old_{c}"), F.col(f"new_{c}"), (F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"delta_{c}"))]
    order = F.when(F.col("kind") == "matched", 0).when(F.col("kind") == "new", 1).otherwise(2)
    return d.select(*shown, "reason", *prices, order.alias("kind_ord"), "row_num")


def log_order() -> list[Column]:
    """Changes and closings in master order, new ones by region, name and address."""
    return [F.col("kind_ord"), F.when(F.col("kind_ord") != 1, F.col("row_num")), F.col("region"), F.col("name"), F.col("address")]


def in_log_order(log: DataFrame) -> DataFrame:
    return log.orderBy(*log_order())


def sequenced(log: DataFrame) -> DataFrame:
    """The log with `seq`, its place in the log's order, which a table of several files keeps; rows lie in this order in each file."""
    return numbered(log, log_order(), "seq").drop("kind_ord", "row_num")


def template(rows: DataFrame) -> DataFrame:
    """The carried columns of the last row before the update, kept or closed, as one row: of a master, or of the pairs that have one."""
    return rows.agg(F.max_by(F.struct(*CARRIED), "row_num").alias("last"))


def merged(pairs: DataFrame, last: DataFrame) -> DataFrame:
    """The next master: every matched row takes the feed's text and prices; new rows inherit the carried columns of
    `last`, the template. One pass over the pairs."""
    d = pairs.where("kind <> 'closed'").join(F.broadcast(last), how="left")  # the template is one row
    side = lambda c: F.when(F.col("in_feed"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
    added = F.col("kind") == "new"
    own = [c for c in ("row_id",) if c in d.columns]
    return d.select(*own, "row_num", *map(side, (*TEXTS, *FUELS)), *(F.when(added, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED), F.coalesce(EXCLUDED, F.lit(False)).alias(EXCLUDED), added.alias("added"))


def with_key(master: DataFrame) -> DataFrame:
    """A master's rows with their keys, null where the address is blank."""
    return settled(master.withColumn("address_key", F.when(trim(F.col("address")) != "", address_key(F.col("address")))))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places in the order: rows are dealt by ranges of the whole order, so that a frequent key is dealt by the rest of
    it, numbered where they are, and each range is moved on by the rows of those before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id())
    dealt = kept(dealt, "order").withColumn("range__", F.shiftrightunsigned("at__", 33))
    counts = dealt.groupBy("range__").agg(F.count("*").alias("n__"))  # a row for each range
    before = counts.select("range__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    return dealt.join(F.broadcast(before), "range__").withColumn(name, F.col("before__") + F.col("at__").bitwiseAND((1 << 33) - 1) + 1).drop("at__", "range__", "before__")


def positions(df: DataFrame, key: str, order: list[Column], name: str = "position") -> DataFrame:
    """Places in the order (key nulls last, then order). Rows are read twice and written once: give the columns that count."""
    return numbered(df, [F.col(key).asc_nulls_last(), *order], name)


def ranks_of(keys: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """(key, rank) of each different key that isn't null: 1, 2, 2, 4 in ascending order. Rows are counted for each key first, so a frequent one is one
    row; different keys are dealt by ranges, summed up within each, and moved on by the totals of the ranges before."""
    counts = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n__"))
    dealt = kept(counts.repartitionByRange(key).sortWithinPartitions(key).withColumn("at__", F.monotonically_increasing_id()), "counts")
    dealt = dealt.withColumn("range__", F.shiftrightunsigned("at__", 33))
    ahead = lambda w: F.coalesce(F.sum("n__").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt.groupBy("range__").agg(F.sum("n__").alias("n__")).select("range__", ahead(Window.orderBy("range__")).alias("before__"))  # a row for each range
    own = dealt.withColumn("ahead__", ahead(Window.partitionBy("range__").orderBy("at__")))
    return own.join(F.broadcast(totals), "range__").select(key, (F.col("before__") + F.col("ahead__") + 1).alias(name))


def competition_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """df with 1, 2, 2, 4 in ascending order of the key, null for null. df is read twice: keep it first if that is dear."""
    return df.join(ranks_of(df.select(key), key, name), key, "left")

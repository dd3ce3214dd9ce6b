"""Quality gates: metrics as rows, checked in order before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.region import REGIONS, flexible_of_keys
from ..functions.text import address_key, settled


class GateError(ValueError):
    """A gate that stops a run, with its name and figures."""


def region_counts(pairs: DataFrame) -> DataFrame:
    """Feed, existing and matched rows of each target region, in one pass over the pairs: a row counts for the region of its feed side
    and for that of its master side, which may differ."""
    r, a = address_key(F.col("old_region")), address_key(F.col("old_address"))
    keys = settled(pairs.select("kind", "in_feed", "in_master", "new_region", r.alias("r"), a.alias("a")))
    sides = F.array(F.struct(F.when(F.col("in_feed"), F.col("new_region")).alias("region"), F.lit(True).alias("feed")), F.struct(F.when(F.col("in_master"), flexible_of_keys(F.col("r"), F.col("a"))).alias("region"), F.lit(False).alias("feed")))
    d = keys.select("kind", F.inline(sides)).where("region is not null")
    return d.groupBy("region").agg(F.count_if("feed").alias("feed_rows"), F.count_if(~F.col("feed")).alias("existing_rows"), F.count_if(~F.col("feed") & (F.col("kind") == "matched")).alias("matched_rows"))


def feed_quality(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count("*").alias("n"), F.count_if(F.col("brand") != "").alias("brands"), F.count("diesel").alias("diesel"), F.count("gasoline").alias("gasoline"), F.count("premium").alias("premium"))


def totals(pairs: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    return pairs.agg(count(F.col("in_master")).alias("existing"), count(F.col("kind") == "closed").alias("closed"), count(F.col("kind") == "new").alias("added"), count((F.col("kind") == "matched") & (F.col("reason") != "")).alias("changed"))


def half(n: int) -> int:
    return (n + 1) // 2


def _first(condition: Column, row: str, *columns: str) -> list[Column]:
    """The first row of those that meet a condition: its number, and the given columns of it."""
    own = F.when(condition, F.col(row))
    return [F.min(own).alias(f"first_{row}"), *(F.min_by(c, own).alias(f"first_{c}") for c in columns)]


def feed_metrics() -> tuple[list[Column], list[Column], list[Column]]:
    """Of checked rows: how many rows of target regions there are and what they have; the first broken rule; the first contradiction."""
    ok = F.expr("error is null and state = 'ok'")
    broken = F.expr("coalesce(error is not null and not startswith(error, 'region'), false)")
    contradicts = F.expr("coalesce(startswith(error, 'region'), false)")
    quality = [F.count_if(ok).alias("n"), F.count_if(ok & (F.col("brand") != "")).alias("brands"), *(F.count_if(ok & F.col(c).isNotNull()).alias(c) for c in ("diesel", "gasoline", "premium"))]
    regions = [F.count_if(ok & (F.col("target") == r)).alias(r) for r in REGIONS]
    return [*quality, *regions], _first(broken, "row_num", "error"), _first(contradicts, "row_num", "error", "region", "address")


def with_target(pairs: DataFrame) -> DataFrame:
    """Pairs with the region for which their master side counts."""
    r, a = address_key(F.col("old_region")), address_key(F.col("old_address"))
    d = settled(pairs.withColumns({"r__": r, "a__": a}))
    return settled(d.withColumn("target", F.when(F.col("in_master"), flexible_of_keys(F.col("r__"), F.col("a__")))).drop("r__", "a__"))


def pair_metrics() -> list[Column]:
    """Of pairs `with_target` of rows that are first of their keys (feed.once): totals, keys that occur twice, and the existing and
    matched rows of each region."""
    kind = F.col("kind")
    twice = F.coalesce(F.col("master_times") > 1, F.lit(False))
    totals = {"existing": F.col("in_master"), "closed": kind == "closed", "added": kind == "new", "changed": (kind == "matched") & (F.col("reason") != "")}
    own = [*(F.count_if(c).alias(k) for k, c in totals.items()), F.count_if(F.col("feed_times") > 1).alias("feed_twice")]
    own += [*_first(twice, "row_num", "address_key", "master_last_row")]
    return own + [x for r in REGIONS for x in (F.count_if(F.col("target") == r).alias(f"existing {r}"), F.count_if((F.col("target") == r) & (kind == "matched")).alias(f"matched {r}"))]


def check_format(broken: dict) -> None:
    """Format errors come before all others."""
    if broken["first_row_num"] is not None:
        raise GateError(f"a row breaks a rule: {broken}")


def check_order(contradiction: dict, rows: DataFrame | None) -> None:
    """Of contradictions and keys that come again, the first in the order of rows stops a run. `rows` has the target regions' rows
    (address_key, row_num, ...), if a key occurs twice: only then are they looked at."""
    at = contradiction["first_row_num"]
    if rows is not None:
        again = rows.withColumn("k", F.row_number().over(Window.partitionBy("address_key").orderBy("row_num"))).where("k = 2")
        second = again.orderBy("row_num").select("row_num", "address_key", "name").first()
        if at is None or second["row_num"] < at:
            raise GateError(f"a key occurs twice in the feed: {second.asDict()}")
    if at is not None:
        raise GateError(f"region and address contradict: {contradiction}")


def check_coverage(q: dict) -> None:
    """The feed has rows of each region, and brands and prices in at least half of them."""
    if not q["n"]:
        raise GateError("the feed has no row of a target region")
    for region in REGIONS:
        if not q[region]:
            raise GateError(f"the feed has no row of {region}")
    for c in ("brands", "diesel", "gasoline"):
        if q[c] < half(q["n"]):
            raise GateError(f"{c} are filled in {q[c]} of {q['n']} rows")
    if not q["premium"]:
        raise GateError("no row has a premium price")


def check_keys(seen: dict) -> None:
    """The first key of the master that is there twice, with its first and last row."""
    if seen["first_row_num"] is not None:
        raise GateError(f"a key occurs twice in the master: rows {seen['first_row_num']} and {seen['first_master_last_row']} have {seen['first_address_key']}")


def check_result(seen: dict) -> None:
    for region in REGIONS:
        existing, matched = seen[f"existing {region}"], seen[f"matched {region}"]
        if existing and matched < half(existing):
            raise GateError(f"{region}: {matched} of {existing} rows are matched")
    if not seen["existing"]:
        raise GateError("the master has no rows")
    if seen["closed"] >= half(seen["existing"]):
        raise GateError(f"{seen['closed']} of {seen['existing']} rows would be closed")

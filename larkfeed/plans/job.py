"""One run: validate, compare, merge, price, order, check and commit."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import REGIONS
from ..operators import gates, pricing, reconcile, verify
from ..operators.feed import FUELS, TEXTS, checked, typed
from ..sources import store
from ..sources.scratch import dropped, kept, kept_seen, mark

#: Buckets of the stored master's key: choose them so that a bucket is some 100 MB to 1 GB.
BUCKETS = 16


def kst_date(now: datetime) -> str:
    """The date in Korea of a moment."""
    return now.astimezone(timezone(timedelta(hours=9))).strftime("%Y-%m-%d")


def terminal_safe(text: str) -> str:
    """Control and bidirectional characters escaped."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f؜‎‏‪-‮⁦-⁩]", lambda m: f"\\u{{{ord(m[0]):x}}}", text)


def priced_in_order(master: DataFrame, params: pricing.Params) -> DataFrame:
    """The priced master with `rank` and `position`. Only what the order needs, and `row_id`, is dealt by ranges; its places and
    ranks are joined to the rows. A row whose region has no rate though one applies is an error, found on the way."""
    p = pricing.priced(master, params)
    keys = p.select("row_id", "row_num", "region", "name", "address", "regional_total", *(f"order_{c}" for c in FUELS), "missing_rate")
    keys, (seen,) = kept_seen(keys, "keys", [F.count_if("missing_rate").alias("missing")])
    keys = keys.drop("missing_rate")
    if seen["missing"]:
        raise gates.GateError("a region to which the local currency applies has no rate")
    at = reconcile.positions(keys, "regional_total", pricing.order_keys())
    at = reconcile.competition_rank(at, "regional_total").select("row_id", "rank", "position")
    return p.join(at, "row_id").drop("row_id")


def summary(pairs: DataFrame, seen: dict, feed: dict, limit: int = 20) -> list[str]:
    """Counts and the first rows of what is new and closed, as text."""
    lines = [f"{k}: {seen[k]}" for k in ("existing", "closed", "added", "changed")]
    new_order = [F.col(f"new_{c}") for c in ("region", "name", "address")]
    for kind, side, order, n in (("new", "new", new_order, seen["added"]), ("closed", "old", [F.col("row_num")], seen["closed"])):
        rows = pairs.where(F.col("kind") == kind).orderBy(*order).limit(limit).collect()
        lines += [terminal_safe(f"{kind}: {r[f'{side}_region']} {r[f'{side}_name']} {r[f'{side}_address']}") for r in rows]
        lines += [f"... of {n}"] if n > limit else []
    return lines + [f"{r}: {feed[r]} {seen[f'existing {r}']} {seen[f'matched {r}']}" for r in REGIONS]


def state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, int]:
    """The master of the current version: rows with a key, kept by buckets of it, the others, and the number of buckets. A row's number
    is its place."""
    own = ("address_key", F.col("position").alias("row_num"), *TEXTS, *FUELS, *reconcile.CARRIED, reconcile.EXCLUDED)
    addressed, unaddressed = (store.read(spark, root, t).select(*own) for t in ("master", "unaddressed"))
    return addressed, unaddressed, store.current(spark, root)["tables"]["master"]["buckets"]


def seed(spark: SparkSession, root: str, master: DataFrame, buckets: int = BUCKETS) -> int:
    """A first version from a master table that has only its own columns."""
    keyed = reconcile.keyed(master).withColumn("position", F.col("row_num").cast("long"))
    parts = {"master": keyed.where("address_key is not null"), "unaddressed": keyed.where("address_key is null")}
    return store.commit(spark, root, parts, buckets={"master": ("address_key", buckets)})


def run(spark: SparkSession, root: str, feed_raw: DataFrame, params: pricing.Params, now: datetime, buckets: int = BUCKETS) -> list[str]:
    """One run from the current version to the next. The checked feed and the pairs are each written once; the gates, in their order,
    are judged by what was observed meanwhile, and nothing is committed unless all hold."""
    since = mark()
    try:
        with store.run_lock(spark, root):
            rows, (quality, broken, contradiction) = kept_seen(checked(feed_raw), "feed", *gates.feed_metrics())
            gates.check_format(broken)
            feed = typed(rows, "row_num")
            pairs = gates.with_target(reconcile.stored_compared(feed, *state(spark, root)))
            pairs, (seen,) = kept_seen(pairs.withColumn("row_id", F.monotonically_increasing_id()), "pairs", gates.pair_metrics())
            gates.check_order(contradiction, feed if seen["feed_twice"] else None)
            gates.check_coverage(quality)
            gates.check_keys(seen)
            out = priced_in_order(reconcile.merged(pairs, reconcile.template(pairs.where("in_master"))), params)
            gates.check_result(seen)
            out = kept(reconcile.with_key(out), "master")
            log = reconcile.sequenced(reconcile.change_log(pairs)).withColumn("as_of", F.lit(kst_date(now)))
            tables = {"master": out.where("address_key is not null"), "unaddressed": out.where("address_key is null"), "change_log": log}
            store.commit(spark, root, tables, lambda back: verify.check(back["master"].unionByName(back["unaddressed"]), params), {"master": ("address_key", buckets)})
            return summary(pairs, seen, quality)
    finally:
        dropped(spark, since)

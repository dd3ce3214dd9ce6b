"""The registered queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, region, text
from ..operators import gates, pricing, reconcile, verify
from ..operators.feed import FUELS, checked, duplicate_keys, typed
from ..sources import store
from ..sources.fixtures import FEED_RAW, INPUTS, MASTER, RATES, feed_raw, inputs, master, rates
from ..sources.landing import HEADER, relanded
from ..sources.scratch import folder, kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PARAMS = pricing.Params()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return typed(checked(feed_raw(spark, d)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.compared(_feed(spark, d), master(spark, d))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.priced(reconcile.keyed(master(spark, d)), PARAMS)


# ---------------------------------------------------------------- SQL of the oracle

_KEY = r"regexp_replace(regexp_replace(replace(replace(regexp_replace({c}, '[\s\x{{00A0}}\x{{3000}}()\[\]{{}},.]', '', 'g'), '충청남도', '충남'), '충청북도', '충북'), '대전(광역시)+', '대전', 'g'), '세종(특별자치시)+', '세종', 'g')"


def key_sql(c: str) -> str:
    return _KEY.format(c=c)


_PRICE = "CASE WHEN {c} IN ('', '-') THEN NULL ELSE nullif(CAST(floor(CAST(replace({c}, ',', '') AS DOUBLE) + 0.5) AS INT), 0) END"
_TARGET = "CASE WHEN region LIKE '대전%' THEN '대전' WHEN region = '세종시' THEN '세종' WHEN region = '충북 청주시' THEN '청주' WHEN region LIKE '충남 %' THEN replace(replace(region, '충남 ', ''), '시', '') END"
FEED_CTE = f"raw AS ({FEED_RAW}), feed AS (SELECT {key_sql('address')} AS address_key, {_TARGET} AS region, name, address, brand, self_yn, {', '.join(f'{_PRICE.format(c=c)} AS {c}' for c in FUELS)} FROM raw WHERE {_TARGET} IS NOT NULL)"
MASTER_CTE = f"sheet AS ({MASTER}), old AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {c} > 0 THEN {c} END AS {c}' for c in FUELS)}) FROM sheet WHERE region <> '' OR name <> '' OR address <> ''), master AS (SELECT nullif({key_sql('address')}, '') AS address_key, old.* FROM old)"


def flexible_sql(r: str, a: str) -> str:
    """The rule of counting, on address keys r and a."""
    districts = "(대덕구|동구|서구|유성구|중구)"
    prefix = lambda c: f"CASE WHEN regexp_matches({c}, '^대전{districts}') THEN '대전' WHEN regexp_matches({c}, '^세종') THEN '세종' WHEN regexp_matches({c}, '^(충북)?청주') THEN '청주' WHEN regexp_matches({c}, '^(충남)?(공주|보령|아산|천안)') THEN regexp_extract({c}, '공주|보령|아산|천안') END"
    return f"CASE WHEN {r} <> '대전' AND ({prefix(r)}) IS NOT NULL THEN {prefix(r)} WHEN ({prefix(a)}) IS NOT NULL THEN {prefix(a)} WHEN {r} = '대전' AND regexp_matches({a}, '^{districts}') THEN '대전' END"


_CHANGED = " OR ".join(f"f.{c} IS DISTINCT FROM m.{c}" for c in FUELS)
_REASON = f"concat_ws(', ', CASE WHEN {_CHANGED} THEN '가격변동' END, CASE WHEN f.region <> m.region THEN '지역정정' END, CASE WHEN f.name <> m.name THEN '상호변경' END, CASE WHEN f.brand <> m.brand THEN '상표변경' END, CASE WHEN f.self_yn <> m.self_yn THEN '셀프여부변경' END)"
PAIRS_CTE = f"""{FEED_CTE}, {MASTER_CTE}, pairs AS (SELECT coalesce(f.address_key, m.address_key) AS address_key, m.row_num,
 CASE WHEN m.row_num IS NULL THEN 'new' WHEN m.address_key IS NULL THEN 'unaddressed' WHEN f.address_key IS NULL THEN 'closed' ELSE 'matched' END AS kind,
 CASE WHEN m.row_num IS NULL THEN '신규' WHEN m.address_key IS NULL THEN '' WHEN f.address_key IS NULL THEN '폐업' ELSE {_REASON} END AS reason,
 {', '.join(f'f.{c} AS new_{c}, m.{c} AS old_{c}' for c in (*('region', 'name', 'address', 'brand', 'self_yn'), *FUELS))}, m.ultra_flag, m.currency_apply, m.smart_excluded
 FROM feed f FULL OUTER JOIN master m ON f.address_key = m.address_key)"""
_LOG = "SELECT coalesce(new_region, old_region) AS region, coalesce(new_name, old_name) AS name, coalesce(new_address, old_address) AS address, reason, " + ", ".join(f"old_{c}, new_{c}, new_{c} - old_{c} AS delta_{c}" for c in FUELS) + " FROM pairs WHERE reason <> ''"
LOG_COLUMNS = ["region", "name", "address", "reason", *(f"{s}_{c}" for c in FUELS for s in ("old", "new", "delta"))]
#: The prices of the master in whole won: quantities 30, 0 and 20, discount -25, rate 7 % in the seven regions and none elsewhere.
PRICED_CTE = f"""{MASTER_CTE}, s AS (SELECT *, CASE WHEN contains(name, '현대오일뱅크') AND contains(name, '직영') AND NOT smart_excluded THEN -25 ELSE 0 END AS sd, CASE WHEN upper(trim(currency_apply)) <> 'Y' THEN 0 WHEN region IN ('대전', '세종', '청주', '공주', '보령', '아산', '천안') THEN 7 END AS pct FROM old),
 t AS (SELECT *, gasoline + sd AS ag, premium + sd AS ap, diesel + sd AS ad, CAST((gasoline + sd) * 30 + (diesel + sd) * 20 AS BIGINT) AS total FROM s),
 priced AS (SELECT *, CAST(total * pct // 100 AS BIGINT) AS discount, CAST(total - total * pct // 100 AS BIGINT) AS regional FROM t)"""


# ---------------------------------------------------------------- feed


@query(f"WITH {FEED_CTE} SELECT * FROM feed")
def feed_typed(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d)


@query(f"WITH raw AS ({FEED_RAW}) SELECT row_number() OVER (ORDER BY row_num) AS row_num, {', '.join(HEADER.values())} FROM raw")
def landed_feed(spark: SparkSession, d: str) -> DataFrame:
    """The feed from snapshot files with control totals."""
    return relanded(feed_raw(spark, d), "row_num")


@query(f"WITH {FEED_CTE} SELECT row_num, {', '.join(f'{_PRICE.format(c=c)} AS {c}' for c in FUELS)} FROM raw")
def feed_price_parse(spark: SparkSession, d: str) -> DataFrame:
    return feed_raw(spark, d).select("row_num", *(parse.feed_price(F.col(c))[0].alias(c) for c in FUELS))


@query(f"WITH raw AS ({FEED_RAW}) SELECT row_num, {key_sql('address')} AS address_key FROM raw")
def address_keys(spark: SparkSession, d: str) -> DataFrame:
    return feed_raw(spark, d).select("row_num", text.address_key(F.col("address")).alias("address_key"))


@query(f"WITH raw AS ({FEED_RAW}) SELECT row_num, {_TARGET} AS region, CASE WHEN {_TARGET} IS NULL THEN 'dropped' ELSE 'ok' END AS state FROM raw")
def feed_region_strict(spark: SparkSession, d: str) -> DataFrame:
    value, state = region.strict(F.col("region"), F.col("address"))
    return feed_raw(spark, d).select("row_num", value.alias("region"), state.alias("state"))


@query(f"WITH raw AS ({FEED_RAW}) SELECT row_num, CASE WHEN {_TARGET} = '대전' THEN 'disagree' WHEN {_TARGET} IS NULL THEN 'address only' ELSE 'disagree' END AS state FROM raw WHERE row_num % 7 = 0 AND NOT coalesce({_TARGET} = '세종', false)")
def feed_region_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The contradictions of a feed in which every seventh row has its address moved to Sejong."""
    moved = feed_raw(spark, d).withColumn("address", F.when(F.expr("row_num % 7 = 0"), F.lit("세종특별자치시 한누리대로")).otherwise(F.col("address")))
    _, state = region.strict(F.col("region"), F.col("address"))
    return text.settled(moved.select("row_num", state.alias("state"))).where("state not in ('ok', 'dropped')")


@query(f"WITH {MASTER_CTE}, k AS (SELECT row_num, {key_sql('region')} AS r, {key_sql('address')} AS a FROM old) SELECT row_num, {flexible_sql('r', 'a')} AS target FROM k")
def master_region_flexible(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.keyed(master(spark, d)).select("row_num", region.flexible(F.col("region"), F.col("address")).alias("target"))


# ---------------------------------------------------------------- comparison


def _kind(kind: str, columns: list[str]) -> Query:
    return lambda spark, d: _pairs(spark, d).where(F.col("kind") == kind).select(*columns)


for _name, _k, _c in (("matched", "matched", ["address_key", "new_name", "old_name"]), ("closed", "closed", ["address_key", "old_region", "old_name", "old_address"]), ("new_stations", "new", ["address_key", "new_region", "new_name", "new_address"])):
    QUERIES[_name] = _kind(_k, _c)
    ORACLES[_name] = f"WITH {PAIRS_CTE} SELECT {', '.join(_c)} FROM pairs WHERE kind = '{_k}'"


@query(f"WITH {PAIRS_CTE} SELECT address_key, kind, reason FROM pairs")
def change_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("address_key", "kind", "reason")


@query(f"WITH {PAIRS_CTE} {_LOG}")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.change_log(_pairs(spark, d)).select(*LOG_COLUMNS)


@query(f"WITH {PAIRS_CTE} SELECT reason, count(*) AS n FROM pairs WHERE reason <> '' GROUP BY reason")
def change_counts_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS_CTE}, last AS (SELECT ultra_flag, currency_apply FROM old ORDER BY row_num DESC LIMIT 1),
 kept AS (SELECT {', '.join(f'coalesce(new_{c}, old_{c}) AS {c}' for c in ('region', 'name', 'address', 'brand', 'self_yn'))}, {', '.join(f"CASE WHEN kind = 'matched' THEN new_{c} ELSE old_{c} END AS {c}" for c in FUELS)}, ultra_flag, currency_apply, smart_excluded, false AS added FROM pairs WHERE kind IN ('matched', 'unaddressed')),
 fresh AS (SELECT {', '.join(f'new_{c} AS {c}' for c in ('region', 'name', 'address', 'brand', 'self_yn', *FUELS))}, (SELECT ultra_flag FROM last) AS ultra_flag, (SELECT currency_apply FROM last) AS currency_apply, false AS smart_excluded, true AS added FROM pairs WHERE kind = 'new')
 SELECT * FROM kept UNION ALL SELECT * FROM fresh""")
def merged_master(spark: SparkSession, d: str) -> DataFrame:
    pairs = kept(_pairs(spark, d), "pairs")
    return reconcile.merged(pairs, reconcile.template(pairs.where("in_master"))).drop("row_num")


ORACLES["merged_master_stored"] = ORACLES["merged_master"]


@query()
def merged_master_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from a master that is kept by buckets of its key: only the feed is dealt."""
    m = reconcile.keyed(master(spark, d))
    path = folder(spark, "master")
    store.write_bucketed(m.where("address_key is not null"), path, "address_key", 8)
    addressed = store.read_bucketed(spark, path, store.ddl_of(m), "address_key", 8)
    rest = kept(m.where("address_key is null"), "unaddressed")
    pairs = reconcile.stored_compared(typed(checked(feed_raw(spark, d)), "row_num"), addressed, rest, 8)
    last = reconcile.template(addressed.select(*reconcile.CARRIED, "row_num").unionByName(rest.select(*reconcile.CARRIED, "row_num")))
    return reconcile.merged(pairs, last).drop("row_num")


@query(f"""WITH {PAIRS_CTE}, log AS (SELECT coalesce(new_region, old_region) AS region, coalesce(new_name, old_name) AS name, coalesce(new_address, old_address) AS address, reason, row_num, CASE kind WHEN 'matched' THEN 0 WHEN 'new' THEN 1 ELSE 2 END AS k FROM pairs WHERE reason <> '')
 SELECT row_number() OVER (ORDER BY k, CASE WHEN k <> 1 THEN row_num END, region, name, address) AS seq, region, name, address, reason FROM log""")
def change_log_order(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stored table has it: each row with its place."""
    return kept(reconcile.sequenced(reconcile.change_log(_pairs(spark, d))), "log").select("seq", "region", "name", "address", "reason")


# ---------------------------------------------------------------- gates

@query(f"WITH {PAIRS_CTE}, f AS (SELECT region, count(*) AS n FROM feed GROUP BY region), k AS (SELECT kind, {key_sql('old_region')} AS r, {key_sql('old_address')} AS a FROM pairs WHERE kind <> 'new'), t AS (SELECT kind, {flexible_sql('r', 'a')} AS region FROM k), m AS (SELECT region, count(*) AS n, count(*) FILTER (kind = 'matched') AS k FROM t WHERE region IS NOT NULL GROUP BY 1) SELECT coalesce(f.region, m.region) AS region, coalesce(f.n, 0) AS feed_rows, coalesce(m.n, 0) AS existing_rows, coalesce(m.k, 0) AS matched_rows FROM f FULL OUTER JOIN m ON f.region = m.region")
def region_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.region_counts(_pairs(spark, d))


@query(f"WITH {FEED_CTE} SELECT count(*) AS n, count(*) FILTER (brand <> '') AS brands, count(diesel) AS diesel, count(gasoline) AS gasoline, count(premium) AS premium FROM feed")
def feed_quality(spark: SparkSession, d: str) -> DataFrame:
    return gates.feed_quality(_feed(spark, d))


@query(f"WITH {PAIRS_CTE} SELECT count(*) FILTER (kind <> 'new') AS existing, count(*) FILTER (kind = 'closed') AS closed, count(*) FILTER (kind = 'new') AS added, count(*) FILTER (kind = 'matched' AND reason <> '') AS changed FROM pairs")
def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    return gates.totals(_pairs(spark, d))


@query(f"WITH {FEED_CTE}, twice AS (SELECT address_key FROM feed UNION ALL SELECT address_key FROM feed WHERE brand = '') SELECT address_key, count(*) AS n FROM twice GROUP BY address_key HAVING count(*) > 1")
def feed_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur twice in a feed that has its rows without a brand twice."""
    feed = _feed(spark, d)
    return duplicate_keys(feed.unionByName(feed.where("brand = ''")), "address_key")


@query(f"WITH {MASTER_CTE}, twice AS (SELECT address_key, row_num FROM master UNION ALL SELECT address_key, row_num + 1000000 FROM master WHERE ultra_flag = 'U') SELECT address_key, count(*) AS n, min(row_num) AS first_row, max(row_num) AS last_row FROM twice WHERE address_key IS NOT NULL GROUP BY address_key HAVING count(*) > 1")
def master_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same for a master that has its flagged rows twice."""
    m = master(spark, d)
    more = m.where("ultra_flag = 'U'").withColumn("row_num", F.col("row_num") + 1_000_000)
    return duplicate_keys(reconcile.keyed(m.unionByName(more)).where("address_key is not null"), "address_key", row="row_num")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- prices


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


@query(f"WITH {PRICED_CTE} SELECT row_num, CAST(sd AS BIGINT) AS smart_discount, CAST(ag AS BIGINT) AS adj_gasoline, CAST(ap AS BIGINT) AS adj_premium, CAST(ad AS BIGINT) AS adj_diesel FROM priced")
def adjusted_prices(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("row_num", *_long("smart_discount", *(f"adj_{c}" for c in FUELS)))


@query(f"WITH {PRICED_CTE} SELECT row_num, total AS total_price FROM priced")
def total_price(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("row_num", *_long("total_price"))


@query(f"WITH {PRICED_CTE} SELECT row_num, CASE WHEN total IS NOT NULL THEN CAST(pct AS BIGINT) END AS region_percent, discount AS region_discount, regional AS regional_total, coalesce(regional, 1000000000000000) AS sort_key FROM priced")
def regional_discount(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("row_num", (100 * F.col("region_rate")).cast("long").alias("region_percent"), *_long("region_discount", "regional_total", "sort_key"))


@query(f"WITH {PRICED_CTE} SELECT row_num, CAST(regional AS DOUBLE) / 50.0::DOUBLE AS unit_price_with, CAST(total AS DOUBLE) / 50.0::DOUBLE AS unit_price_without FROM priced")
def unit_prices(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("row_num", "unit_price_with", "unit_price_without")


@query(f"WITH {PRICED_CTE} SELECT row_num, CASE WHEN total IS NOT NULL THEN '휘발유 ' || format('{{:,}}', ag * 30) || '원 / 경유 ' || format('{{:,}}', ad * 20) || '원' END AS fuel_total_text FROM priced")
def fuel_total_text(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("row_num", "fuel_total_text")


_CELL = "(SELECT CAST(floor(CAST(replace(value, ',', '') AS DOUBLE) + 0.5) AS BIGINT) FROM cells WHERE name = '{}')"
_CELLS = ", ".join(f"{_CELL.format(f'{k}_{c}')} AS {k[0]}_{c}" for k in ("quantity", "average") for c in FUELS)


@query(f"WITH cells AS ({INPUTS}), c AS (SELECT {_CELLS}) SELECT CAST(q_gasoline + q_premium + q_diesel AS DOUBLE) AS quantity, CAST(q_gasoline * a_gasoline + q_premium * a_premium AS DOUBLE) / (q_gasoline + q_premium) AS average_with_premium, CAST(q_gasoline * a_gasoline + q_premium * a_diesel AS DOUBLE) / (q_gasoline + q_premium) AS average_with_diesel, CAST(NULL AS VARCHAR) AS error FROM c")
def input_summary(spark: SparkSession, d: str) -> DataFrame:
    return pricing.input_summary(inputs(spark, d))


RATES_CTE = f"rows AS ({RATES}), rates AS (SELECT trim(region) AS region, arg_max(rate, row_num) AS rate FROM rows WHERE rate <> '' AND trim(region) IN ('대전', '세종', '청주', '공주', '보령', '아산', '천안') GROUP BY 1)"


@query(f"WITH {RATES_CTE} SELECT region, CAST(round(CAST(rate AS DOUBLE) * 100) AS BIGINT) AS percent FROM rates")
def region_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rates of a run from their table."""
    return pricing.last_rates(rates(spark, d)).select("region", (100 * F.col("rate")).cast("long").alias("percent"))


def _ratio_sql(x: str) -> str:
    """x / D for an odd D that ends never but in whole numbers, of four digits before the point."""
    digits = f"replace(format('{{:.16e}}', CAST({x} AS DOUBLE) / CAST(D AS DOUBLE)), '.', '')"
    return f"CASE WHEN {x} % D = 0 THEN CAST({x} // D AS VARCHAR) WHEN {x} IS NOT NULL THEN substr({digits}, 1, 4) || '.' || rtrim(substr({digits}, 5, 13), '0') END"


#: Totals and quantities twice, as both may end in a half.
LOADED_CTE = f"""{MASTER_CTE}, {RATES_CTE}, cells AS ({INPUTS}), v AS (SELECT {', '.join(f"CAST(2 * max(CAST(replace(value, ',', '') AS DOUBLE)) FILTER (name = '{c}') AS BIGINT) AS {c}" for c in ('quantity_gasoline', 'quantity_diesel', 'smart_discount'))} FROM cells),
 s AS (SELECT old.*, v.*, CASE WHEN contains(name, '현대오일뱅크') AND contains(name, '직영') AND NOT smart_excluded THEN smart_discount // 2 ELSE 0 END AS sd, quantity_gasoline + quantity_diesel AS D, CASE WHEN upper(trim(currency_apply)) <> 'Y' THEN 0 ELSE CAST(round(CAST(rates.rate AS DOUBLE) * 100) AS BIGINT) END AS pct FROM old CROSS JOIN v LEFT JOIN rates ON rates.region = old.region),
 t AS (SELECT row_num, D, pct, (gasoline + sd) * quantity_gasoline + (diesel + sd) * quantity_diesel AS total FROM s),
 loaded AS (SELECT row_num, D, 2 * total AS total, 2 * (total - 2 * (total * pct // 200)) AS regional FROM t)"""


@query(f"WITH {LOADED_CTE} SELECT row_num, {_ratio_sql('(regional // 2)')} AS unit_text_with, {_ratio_sql('(total // 2)')} AS unit_text_without FROM loaded")
def unit_price_texts(spark: SparkSession, d: str) -> DataFrame:
    """Unit prices as exact text, with quantities, discount and rates from tables."""
    params = pricing.load_params(inputs(spark, d), rates(spark, d))
    return pricing.with_unit_texts(pricing.priced(reconcile.keyed(master(spark, d)), params), params).select("row_num", "unit_text_with", "unit_text_without")


@query(f"WITH {PRICED_CTE} SELECT row_num, regional AS regional_total, CASE WHEN regional IS NOT NULL THEN rank() OVER (ORDER BY regional NULLS LAST) END AS rank FROM priced")
def price_rank(spark: SparkSession, d: str) -> DataFrame:
    keys = kept(_priced(spark, d).select("row_num", "regional_total"), "keys")
    return reconcile.competition_rank(keys, "regional_total").select("row_num", *_long("regional_total", "rank"))


_ORDER = "regional NULLS LAST, ag * (100 - pct) NULLS LAST, ap * (100 - pct) NULLS LAST, ad * (100 - pct) NULLS LAST, region, name, address, row_num"


@query(f"WITH {PRICED_CTE} SELECT row_num, row_number() OVER (ORDER BY {_ORDER}) AS position FROM priced")
def master_order(spark: SparkSession, d: str) -> DataFrame:
    keys = _priced(spark, d).select("row_num", "region", "name", "address", "regional_total", *(f"order_{c}" for c in FUELS))
    return reconcile.positions(keys, "regional_total", pricing.order_keys()).select("row_num", *_long("position"))


@query(f"WITH {PRICED_CTE} SELECT name, address, regional AS regional_total FROM priced ORDER BY {_ORDER} LIMIT 20")
def cheapest20(spark: SparkSession, d: str) -> DataFrame:
    """The report of the cheapest: its limit is what it is."""
    return _priced(spark, d).orderBy(F.col("regional_total").asc_nulls_last(), *pricing.order_keys()).limit(20).select("name", "address", *_long("regional_total"))


_DIFFERS = {c: "count(*) FILTER (false)" for c in verify.DERIVED} | {"regional_total": "count(*) FILTER (row_num % 13 = 0 AND regional IS NOT NULL)", "rank": "count(*) FILTER (row_num % 17 = 0)", "position": "max(1)", "order": "count(*) FILTER (moved AND regional IS NOT NULL)"}


@query(f"WITH {PRICED_CTE}, p AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) = 1 AS moved FROM priced) " + " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS BIGINT) AS n FROM p" for k, v in _DIFFERS.items()))
def committed_check(spark: SparkSession, d: str) -> DataFrame:
    """What the check of a committed master finds where some totals and ranks are changed and the first place is lost."""
    p = _priced(spark, d).withColumn("row_id", F.col("row_num"))
    keys = kept(p.select("row_id", "row_num", "region", "name", "address", "regional_total", *(f"order_{c}" for c in FUELS)), "keys")
    at = reconcile.competition_rank(reconcile.positions(keys, "regional_total", pricing.order_keys()), "regional_total").select("row_id", "rank", "position")
    stored = p.join(at, "row_id").withColumns({
        "regional_total": F.when(F.expr("row_num % 13 = 0"), F.col("regional_total") + 1).otherwise(F.col("regional_total")).cast("decimal(28,12)"),
        "rank": F.when(F.expr("row_num % 17 = 0"), F.coalesce("rank", F.lit(0)) + 1).otherwise(F.col("rank")), "position": F.when(F.col("position") == 1, 1_000_000_000).otherwise(F.col("position")),
    })
    return verify.problems(stored, PARAMS)


# ---------------------------------------------------------------- number grammars

_TEXTS = "CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN '1,' || CAST(c_custkey AS STRING) || '.5' WHEN 2 THEN '.5' WHEN 3 THEN '-' || CAST(c_custkey AS STRING) || '.5' WHEN 4 THEN '1e3' WHEN 5 THEN '5.' WHEN 6 THEN '99999999999' ELSE '' END"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(_TEXTS).alias("t"))


@query("SELECT c_custkey, CAST(CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN c_custkey WHEN 1 THEN CAST('1' || c_custkey AS BIGINT) + 1 WHEN 2 THEN 1 WHEN 3 THEN -c_custkey - 1 WHEN 5 THEN 5 END AS INT) AS value FROM customer")
def lenient_int_parse(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("c_custkey", parse.lenient_int(F.col("t")).alias("value"))


@query("SELECT c_custkey, CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN CAST(c_custkey AS DOUBLE) WHEN 1 THEN CAST('1' || c_custkey AS DOUBLE) + 0.5 WHEN 3 THEN -c_custkey - CAST(0.5 AS DOUBLE) WHEN 5 THEN 5 WHEN 6 THEN 99999999999 END AS value, c_custkey % 8 IN (2, 4) AS error FROM customer")
def fixed_decimal_parse(spark: SparkSession, d: str) -> DataFrame:
    value, error = parse.fixed_decimal(F.col("t"))
    return _texts(spark, d).select("c_custkey", value.cast("double").alias("value"), error.alias("error"))


@query("SELECT c_custkey, CAST(c_custkey // 4 AS STRING) || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS value FROM customer")
def scaled_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", parse.scaled_text((F.col("c_custkey").cast("decimal(18,0)") / 4).cast("decimal(18,6)")).alias("value"))

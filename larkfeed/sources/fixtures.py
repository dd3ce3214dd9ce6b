"""A feed and a master derived from `customer`, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DISTRICT = "CASE k % 5 WHEN 0 THEN '대덕구' WHEN 1 THEN '동구' WHEN 2 THEN '서구' WHEN 3 THEN '유성구' ELSE '중구' END"
_CITY = "CASE r WHEN 3 THEN '공주' WHEN 4 THEN '보령' WHEN 5 THEN '아산' ELSE '천안' END"
_BASE = "SELECT c_custkey AS k, c_custkey % 9 AS r, 1500 + c_custkey % 400 AS g, 1400 + c_custkey % 300 AS d, 1700 + c_custkey % 250 AS p, c_name, c_mktsegment FROM customer"
_NAME = "CASE WHEN k % 5 = 0 THEN '현대오일뱅크 직영 ' ELSE '' END"

FEED_RAW = f"""SELECT k AS row_num,
 CASE r WHEN 0 THEN '대전 ' || {_DISTRICT} WHEN 1 THEN '세종시' WHEN 2 THEN '충북 청주시' WHEN 7 THEN '서울 강남구' WHEN 8 THEN '부산 해운대구' ELSE '충남 ' || {_CITY} || '시' END AS region,
 {_NAME} || c_name AS name,
 CASE r WHEN 0 THEN '대전광역시 ' || {_DISTRICT} WHEN 1 THEN '세종특별자치시' WHEN 2 THEN '충청북도 청주시' WHEN 7 THEN '서울 강남구' WHEN 8 THEN '부산 해운대구' ELSE '충청남도 ' || {_CITY} || '시' END || ' 길' || CAST(k AS STRING) || ' (동' || CAST(k % 50 AS STRING) || ')' AS address,
 CASE WHEN k % 17 = 0 THEN '' ELSE c_mktsegment END AS brand,
 CASE WHEN k % 3 = 0 THEN '셀프' ELSE '일반' END AS self_yn,
 CASE WHEN k % 23 = 0 THEN '-' ELSE '1,' || CAST(g - 1000 AS STRING) || CASE WHEN k % 7 = 0 THEN '.5' ELSE '' END END AS gasoline,
 CASE WHEN k % 4 = 0 THEN CAST(p AS STRING) ELSE '-' END AS premium,
 CASE WHEN k % 29 = 0 THEN '0' ELSE CAST(d AS STRING) END AS diesel
 FROM ({_BASE}) AS b WHERE k % 11 <> 3"""

#: Beside plain rows: blank ones, some without an address, 대전 without a district, a region that only begins with 대전,
#: prices of zero, manual exclusions, and the flag in lower case with spaces.
MASTER = f"""SELECT k AS row_num,
 CASE WHEN k % 97 = 0 THEN '' WHEN k % 53 = 0 THEN '대전 해운대구' WHEN k % 41 = 0 THEN '공주' WHEN r = 0 THEN '대전' WHEN r = 1 THEN '세종' WHEN r = 2 THEN '청주' ELSE {_CITY} END AS region,
 CASE WHEN k % 97 = 0 THEN '' WHEN k % 31 = 0 THEN {_NAME} || 'Old' || c_name ELSE {_NAME} || c_name END AS name,
 CASE WHEN k % 97 = 0 OR k % 47 = 0 THEN '' WHEN r = 0 AND k % 8 = 3 THEN '대전 한밭대로 ' || CAST(k AS STRING)
  ELSE CASE r WHEN 0 THEN '대전 ' || {_DISTRICT} WHEN 1 THEN '세종' WHEN 2 THEN '충북 청주시' ELSE '충남 ' || {_CITY} || '시' END || ' 길' || CAST(k AS STRING) || ' 동' || CAST(k % 50 AS STRING) END AS address,
 CASE WHEN k % 17 = 0 THEN '' WHEN k % 37 = 0 THEN 'OLDBRAND' ELSE c_mktsegment END AS brand,
 CASE WHEN (k % 3 = 0 AND k % 43 <> 0) OR (k % 3 <> 0 AND k % 43 = 0) THEN '셀프' ELSE '일반' END AS self_yn,
 CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(g + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 10 ELSE 0 END AS INT) END AS gasoline,
 CASE WHEN k % 4 = 0 THEN CAST(p AS INT) WHEN k % 4 = 1 THEN 0 END AS premium,
 CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(d AS INT) END AS diesel,
 CASE WHEN k % 10 = 0 THEN 'U' ELSE '' END AS ultra_flag,
 CASE WHEN k % 6 = 4 THEN ' y ' WHEN k % 2 = 0 THEN 'Y' ELSE 'N' END AS currency_apply,
 k % 15 = 0 AS smart_excluded
 FROM ({_BASE}) AS b WHERE r < 7 AND k % 13 <> 5"""

_CELL = "SELECT '{}' AS name, {} AS value FROM customer"
#: The input cells as text, from the number of customers.
INPUTS = " UNION ALL ".join(
    _CELL.format(name, value)
    for name, value in {
        "quantity_gasoline": "CAST(count(*) % 40 + 10 AS STRING)", "quantity_premium": "CAST(count(*) * 0 AS STRING) || '.0'", "quantity_diesel": "'1,' || CAST(count(*) % 10 AS STRING) || '.5'",
        "average_gasoline": "'1,' || CAST(count(*) % 300 + 600 AS STRING)", "average_premium": "CAST(count(*) % 100 + 1900 AS STRING)", "average_diesel": "CAST(count(*) % 90 + 1409 AS STRING) || '.5'", "smart_discount": "'-' || CAST(count(*) % 7 + 20 AS STRING)",
    }.items()
)
#: The table of rates as text, from the nations: the last rate of a label that isn't blank counts; some labels are no regions.
RATES = """SELECT n_nationkey AS row_num, CASE n_nationkey % 9 WHEN 0 THEN '대전' WHEN 1 THEN ' 세종 ' WHEN 2 THEN '청주' WHEN 3 THEN '공주' WHEN 4 THEN '보령' WHEN 5 THEN '아산' WHEN 6 THEN '천안' WHEN 7 THEN '서울' ELSE '' END AS region,
 CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE '0.0' || CAST(n_nationkey % 7 + 1 AS STRING) || '0' END AS rate FROM nation"""


def _run(spark: SparkSession, sf_dir: str, sql: str, table: str = "customer") -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def feed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FEED_RAW)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, MASTER)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, INPUTS)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RATES, "nation")

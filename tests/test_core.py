from datetime import datetime, timezone
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from larkfeed.functions import parse, region, text
from larkfeed.operators import gates, pricing, reconcile, verify
from larkfeed.operators.feed import checked, duplicate_keys, typed
from larkfeed.plans import job
from larkfeed.plans.queries import ORACLES, QUERIES
from larkfeed.sources import fixtures, landing, scratch, store
from larkfeed.streaming import snapshots

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    made = make(F.col("t"))
    made = made if isinstance(made, tuple) else (made,)
    rows = df.select("i", *(m.alias(f"c{k}") for k, m in enumerate(made))).orderBy("i").collect()
    return [tuple(r)[1:] if len(made) > 1 else r[1] for r in rows]


def test_feed_price(spark):
    good = {None: None, "": None, " ": None, "-": None, "1699": 1699, "1,699": 1699, "+1,699.5": 1700, "1699.49": 1699, "99.5": 100, "0": None, "0.4": None, "100000": 100000, "0,100": 100}
    bad = ["1,69.0", "12345,678", "1,699.", ".5", "-1699", "99", "0.5", "100000.5", "1 699", "9" * 60]
    assert column(spark, list(good), parse.feed_price) == [(v, False) for v in good.values()]
    assert column(spark, bad, parse.feed_price) == [(None, True)] * len(bad)


def test_lenient_int(spark):
    cases = {"1699": 1699, "1,6,99": 1699, ".5": 1, "5.": 5, "-2.5": -3, "1e3": None, "1,699.2,5": None, "-": None, "99999999999": None, "0": 0, None: None}
    assert column(spark, list(cases), parse.lenient_int) == list(cases.values())


def test_fixed_decimal(spark):
    good = {"": None, "-": None, "40": "40.000000", "0.07": "0.070000", "-25": "-25.000000", "1.23450000": "1.234500", "1,000.5": "1000.500000"}
    got = column(spark, list(good), parse.fixed_decimal)
    assert got == [(Decimal(v) if v else None, False) for v in good.values()]
    assert column(spark, [".5", "1.2345678", "1.2.3", "7%"], parse.fixed_decimal) == [(None, True)] * 4


def test_address_key(spark):
    cases = {"충청남도 천안시 서북구 (두정동) 1.2": "충남천안시서북구두정동12", "a　b c": "abc", "대전광역시광역시 중구": "대전중구", "세종특별자치시 한누리대로": "세종한누리대로", "[A] {B}": "AB", "1-2": "1-2", None: ""}
    assert column(spark, list(cases), text.address_key) == list(cases.values())


def test_regions(spark):
    cases = [("대전 서구", "대전광역시 서구 1", "ok"), ("대전", "대전 광역시 서구 1", "ok"), ("세종특별자치시", "세종특별자치시 1", "address only"), ("충남 천안시", "충남 천안 서북구 1", "ok"), ("충남 천안시", "충남 천안 동남구 1", "region only"), ("충남 아산시", "충남 천안시 1", "disagree"), ("충남 홍성군", "충남 홍성군 1", "dropped")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, a string, want string")
    assert df.where(region.strict(F.col("r"), F.col("a"))[1] != F.col("want")).count() == 0
    loose = [("대전", "대전 한밭대로 1", None), ("대전 해운대구", "서울 1", None), ("대전 해운대구", "충남 아산시 1", "아산"), ("대전 서구청", "x", "대전"), ("부산", "대전광역시 유성구 1", "대전"), ("천안", "x", "천안"), ("대전", "서구 둔산로", "대전"), ("대전", "강남구", None), ("대전", "세종 1", "세종"), ("", "충청남도 공주시 1", "공주")]
    df = spark.createDataFrame(loose, "r string, a string, want string")
    assert df.where(~region.flexible(F.col("r"), F.col("a")).eqNullSafe(F.col("want"))).count() == 0


def test_rank_and_positions(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 5000), (5, None)], "id int, t int")
    assert {r["id"]: r["rank"] for r in reconcile.competition_rank(df, "t").collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: None}
    got = reconcile.positions(df, "t", [F.col("id").desc()]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [1, 3, 2, 4, 5]
    # one key in most rows, nulls, many partitions
    values = [7 if i % 3 else None if i % 2 else i * 37 % 1000 - 500 for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, t int").repartition(13)
    order = sorted(range(3000), key=lambda i: (values[i] is None, values[i] or 0, i))
    assert [r["id"] for r in reconcile.positions(df, "t", [F.col("id")]).orderBy("position").collect()] == order
    known = sorted(v for v in values if v is not None)
    assert all(r["rank"] == (None if r["t"] is None else known.index(r["t"]) + 1) for r in reconcile.competition_rank(df, "t").collect())
    empty = df.where("false")
    assert reconcile.positions(empty, "t", [F.col("id")]).count() == reconcile.competition_rank(empty, "t").count() == 0


MASTER_ROW = "row_num int, region string, name string, address string, brand string, self_yn string, gasoline int, premium int, diesel int, ultra_flag string, currency_apply string, smart_excluded boolean"


def master_of(spark, *rows):
    """Rows (row_num, region, name, address, changes)."""
    base = {"brand": "b", "self_yn": "일반", "gasoline": 1000, "premium": None, "diesel": 900, "ultra_flag": "", "currency_apply": "N", "smart_excluded": False}
    return spark.createDataFrame([(n, r, m, a, *({**base, **x}.values())) for n, r, m, a, x in rows], MASTER_ROW)


def feed_of(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_num int, region string, name string, address string, brand string, self_yn string, gasoline string, premium string, diesel string")


def test_blank_and_unaddressed_rows_and_exclusions(spark):
    old = master_of(
        spark, (1, "청주", "현대오일뱅크 직영 A", "충북 청주시 1", {"smart_excluded": True, "currency_apply": "Y"}), (2, " ", "", "", {}), (3, "청주", "no address", " ", {"gasoline": 0, "smart_excluded": True}),
        (4, "청주", "현대오일뱅크 직영 B", "충북 청주시 2", {}), (9, "청주", "gone", "충북 청주시 9", {"ultra_flag": "U", "currency_apply": "Y", "smart_excluded": True}),
    )
    feed = typed(checked(feed_of(spark, *(("충북 청주시", f"현대오일뱅크 직영 {n}", f"충청북도 청주시 {i}", "b", "일반", "1,000", "-", "900") for i, n in ((1, "A"), (2, "B"), (3, "C"))))))
    pairs = reconcile.compared(feed, old)
    assert {r["kind"]: r["n"] for r in pairs.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"matched": 2, "unaddressed": 1, "closed": 1, "new": 1}
    assert gates.totals(pairs).first().asDict() == {"existing": 4, "closed": 1, "added": 1, "changed": 0}
    out = reconcile.merged(pairs, reconcile.template(reconcile.keyed(old)))
    got = {r["name"]: r for r in pricing.priced(out, pricing.Params()).collect()}
    assert set(got) == {"현대오일뱅크 직영 A", "현대오일뱅크 직영 B", "현대오일뱅크 직영 C", "no address"}
    a, b, c, d = got["현대오일뱅크 직영 A"], got["현대오일뱅크 직영 B"], got["현대오일뱅크 직영 C"], got["no address"]
    assert (a["smart_discount"], b["smart_discount"], c["smart_discount"], d["smart_discount"]) == (0, -25, -25, 0)
    assert (c["ultra_flag"], c["currency_apply"], c["smart_excluded"], a["smart_excluded"], d["smart_excluded"]) == ("U", "Y", False, True, True)
    assert d["gasoline"] is None and d["total_price"] is None and d["region_rate"] is None and a["region_rate"] == Decimal("0.07")


def test_pricing_without_quantities_and_with_rounding(spark):
    rows = reconcile.keyed(master_of(spark, (1, "대전", "x", "a", {"gasoline": 1001, "currency_apply": "y"}), (2, "대전", "y", "b", {"gasoline": None})))
    none = pricing.priced(rows, pricing.Params(quantity=dict.fromkeys(("gasoline", "premium", "diesel"), Decimal(0)))).collect()
    assert all(r["total_price"] is None and r["unit_price_with"] is None and r["fuel_total_text"] is None and r["sort_key"] == 10**15 for r in none)
    half = pricing.priced(rows, pricing.Params(quantity={"gasoline": Decimal("0.5"), "premium": Decimal(0), "diesel": Decimal(0)})).orderBy("row_num").collect()
    assert (half[0]["total_price"], half[0]["fuel_total_text"], half[0]["region_discount"]) == (Decimal("500.5"), "휘발유 501원", 35) and half[1]["total_price"] is None
    missing = pricing.priced(rows, pricing.Params(rates={})).orderBy("row_num").collect()
    assert [r["missing_rate"] for r in missing] == [True, False]


def test_params(spark):
    rows = [(4, "대전", "0.5"), (5, "대전", "0.07"), (6, " 세종 ", "0.07"), (7, "청주", "0.0700"), (11, "천안", "0.07"), (12, "천안", ""), (13, "서울", "0.9")]
    rates = spark.createDataFrame(rows, "row_num int, region string, rate string")
    inputs = spark.createDataFrame([("quantity_gasoline", "30"), ("quantity_premium", "0.0"), ("quantity_diesel", "1,9.5"), ("average_gasoline", "1,700"), ("average_premium", "1900"), ("average_diesel", "1499.5"), ("smart_discount", "-25")], "name string, value string")
    got = pricing.load_params(inputs, rates)
    assert got.quantity == {"gasoline": 30, "premium": 0, "diesel": Decimal("19.5")} and got.smart_discount == -25
    assert got.average == {"gasoline": 1700, "premium": 1900, "diesel": 1500} and got.rates == dict.fromkeys(("대전", "세종", "청주", "천안"), Decimal("0.07"))
    assert set(pricing.load_params(fixtures.inputs(spark, SF), fixtures.rates(spark, SF)).rates) == set(region.REGIONS)
    with pytest.raises(ValueError, match="average_diesel"):
        pricing.load_params(inputs.withColumn("value", F.when(F.col("name") != "average_diesel", F.col("value"))), rates)
    with pytest.raises(ValueError, match="천안"):
        pricing.load_params(inputs, rates.withColumn("rate", F.when(F.col("region") == "천안", "7%").otherwise(F.col("rate"))))
    cells = lambda **x: spark.createDataFrame([(k, v) for k, v in ({n: "0" for n in pricing.INPUTS} | x).items()], "name string, value string")
    summary = lambda **x: pricing.input_summary(cells(**x)).first().asDict()
    assert summary() == {"quantity": 0.0, "average_with_premium": None, "average_with_diesel": None, "error": None}
    assert summary(quantity_diesel="5")["error"] == "nothing to divide by"
    assert summary(average_premium="")["error"] == "average_premium is empty"
    assert summary(quantity_gasoline="1", quantity_premium="3", average_gasoline="10", average_premium="20", average_diesel="30")["average_with_diesel"] == 25.0


def test_schemas_and_order_of_errors(spark):
    with pytest.raises(ValueError, match="premium is missing"):
        checked(fixtures.feed_raw(spark, SF).drop("premium"))
    with pytest.raises(ValueError, match="gasoline is string"):
        reconcile.keyed(fixtures.master(spark, SF).withColumn("gasoline", F.col("gasoline").cast("string")))
    rows = [("r", "", "a", "b", "?", "x", "x", "x"), ("r", "", "a", "b", "?", "x", "x", "0"), ("r", "", "a", "b", "?", "0", "x", "0"), ("r", "n", "a", "b", "?", "0", "x", "0"), ("r", "n", "a", "b", "?", "0", "0", "0"), ("r", "n", " ", "b", "?", "x", "x", "x"), ("", " ", "", "", "", "", "", "")]
    assert [r["error"] for r in checked(feed_of(spark, *rows)).orderBy("row_num").collect()] == ["bad diesel", "bad gasoline", "no name", "bad premium", "bad service", "no address"]


def test_result_gates():
    def seen(existing=10, closed=0, **regions):
        return {"existing": existing, "closed": closed, **{f"{k} {r}": 0 for r in region.REGIONS for k in ("existing", "matched")}, **{f"{k} {r}": v for r, x in regions.items() for k, v in zip(("existing", "matched"), x, strict=True)}}

    gates.check_result(seen(10, 4, 대전=(3, 2), 세종=(0, 0)))
    for metrics, message in ((seen(세종=(3, 1), 대전=(5, 2)), "대전: 2 of 5"), (seen(0), "no rows"), (seen(10, 5, 대전=(2, 1)), "would be closed")):
        with pytest.raises(gates.GateError, match=message):
            gates.check_result(metrics)


def test_region_counts(spark):
    """A row counts for the region of either side."""
    old = master_of(spark, (1, "청주", "a", "충북 청주시 1", {}), (2, "대전", "b", "서구 2", {}), (3, "서울", "c", "서울 3", {}))
    feed = typed(checked(feed_of(spark, ("충북 청주시", "a", "충북 청주시 1", "b", "일반", "1,000", "-", "900"), ("세종시", "n", "세종 9", "b", "일반", "1,000", "-", "900"))))
    got = gates.region_counts(reconcile.compared(feed, old)).collect()
    assert sorted(map(tuple, got)) == [("대전", 0, 1, 0), ("세종", 1, 0, 0), ("청주", 1, 1, 1)]


def test_log_order_and_escapes(spark):
    pairs = reconcile.compared(typed(checked(fixtures.feed_raw(spark, SF))), fixtures.master(spark, SF))
    log = reconcile.in_log_order(reconcile.change_log(pairs)).collect()
    parts = [[r for r in log if r["kind_ord"] == k] for k in (0, 1, 2)]
    assert log == [r for p in parts for r in p] and all(parts)
    assert all([r["row_num"] for r in p] == sorted(r["row_num"] for r in p) for p in (parts[0], parts[2]))
    assert [(r["region"], r["name"], r["address"]) for r in parts[1]] == sorted((r["region"], r["name"], r["address"]) for r in parts[1])
    assert job.terminal_safe("a\x1b[31m\u202eb\n") == "a\\u{1b}[31m\\u{202e}b\\u{a}"


def test_snapshots(spark, tmp_path):
    """Each file of a folder is one run of the batch plan, once."""
    feed = fixtures.feed_raw(spark, SF)
    feed.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        snapshots.on_snapshots(spark, str(tmp_path / "in"), feed.schema, str(tmp_path / "state"), lambda df: seen.append(typed(checked(df)).count())).awaitTermination()
    assert seen == [typed(checked(feed)).count()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    want = sorted(want.fetchall(), key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want


NOW = datetime(2026, 1, 1, 20, tzinfo=timezone.utc)
BIG = "/root/testdata/sf0.01"


@pytest.fixture
def root(spark, tmp_path):
    """A store whose first version is the master."""
    job.seed(spark, str(tmp_path / "state"), fixtures.master(spark, BIG), 4)
    return str(tmp_path / "state")


def stored_master(spark, root):
    return store.read(spark, root, "master").unionByName(store.read(spark, root, "unaddressed"))


def test_run_twice(spark, root):
    feed, params = fixtures.feed_raw(spark, BIG), pricing.load_params(fixtures.inputs(spark, BIG), fixtures.rates(spark, BIG))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = job.run(spark, root, feed, params, NOW, 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = reconcile.compared(typed(checked(feed)), fixtures.master(spark, BIG))
    assert lines[:4] == [f"{k}: {v}" for k, v in gates.totals(pairs).first().asDict().items()] and "... of" in " ".join(lines)
    want = [tuple(r) for r in reconcile.in_log_order(reconcile.change_log(pairs)).drop("kind_ord", "row_num").collect()]
    log = store.read(spark, root, "change_log")
    assert len(log.inputFiles()) > 1
    rows = log.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, len(want) + 1)) and [tuple(r)[: len(want[0])] for r in log.select(*reconcile.change_log(pairs).drop("kind_ord", "row_num").columns, "seq").orderBy("seq").collect()] == want
    assert {r["as_of"] for r in rows} == {"2026-01-02"} and store.current(spark, root)["number"] == 2
    verify.check(stored_master(spark, root), params)
    job.run(spark, root, feed, params, NOW, 4)
    assert store.read(spark, root, "change_log").count() == 0 and store.current(spark, root)["number"] == 3
    with store.run_lock(spark, root), pytest.raises(store.Conflict), store.run_lock(spark, root):
        pass


def test_gates_by_observation(spark, root, monkeypatch):
    """Every gate that looks at the feed or the pairs is judged by what was seen while they were written: two writes, no other action."""
    from pyspark.sql.classic.dataframe import DataFrame

    writes, actions = [], []
    keep = scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df, name: writes.append(name) or keep(df, name))
    for name in ("collect", "first", "count", "take", "head", "isEmpty", "toPandas"):
        monkeypatch.setattr(DataFrame, name, (lambda n, f: lambda *a, **k: actions.append(n) or f(*a, **k))(name, getattr(DataFrame, name)))
    monkeypatch.setattr(job, "priced_in_order", lambda *_: (_ for _ in ()).throw(RuntimeError("gates passed")))
    raw = fixtures.feed_raw(spark, BIG)
    with pytest.raises(RuntimeError, match="gates passed"):
        job.run(spark, root, raw, pricing.Params(), NOW, 4)
    assert writes == ["feed", "pairs"] and not actions
    sejong = F.when(F.expr("row_num = 20"), F.lit("세종특별자치시 한누리대로")).otherwise(F.col("address"))
    again = raw.where("row_num = 30").withColumn("row_num", F.lit(10).cast("long"))
    late = raw.where("row_num = 2").withColumn("row_num", F.lit(5000).cast("long"))
    cases = (
        (raw.where("false"), "no row of a target"), (raw.where("row_num % 9 <> 2"), "청주"), (raw.withColumn("premium", F.lit("-")), "premium"), (raw.withColumn("brand", F.lit("")), "brands"), (raw.withColumn("gasoline", F.lit("x")), "rule"), (raw.withColumn("self_yn", F.lit("?")), "rule"),
        (raw.union(raw), "twice"), (raw.withColumn("address", sejong), "contradict.*20"), (raw.withColumn("address", sejong).union(late), "contradict"), (raw.withColumn("address", sejong).union(again).union(again), "twice.*10"),
        (raw.withColumn("address", sejong).withColumn("premium", F.when(F.expr("row_num = 900"), "x").otherwise(F.col("premium"))), "rule.*900"),
    )
    for change, message in cases:
        with pytest.raises(gates.GateError, match=message):
            job.run(spark, root, change, pricing.Params(), NOW, 4)
    assert store.current(spark, root)["number"] == 1


def test_gates_of_the_master(spark, tmp_path):
    feed, old = fixtures.feed_raw(spark, BIG), fixtures.master(spark, BIG)
    for change, params, message in (
        (old.unionByName(old.where("row_num = 2").withColumn("row_num", F.lit(7777).cast("long"))), pricing.Params(), "rows 2 and 7777"), (old, pricing.Params(rates={}), "no rate"),
        (old.withColumn("address", F.concat("address", F.when(F.expr("region = '세종' and address <> ''"), F.lit(" x")).otherwise(""))), pricing.Params(), "세종: 2 of"), (old.where("false"), pricing.Params(), "no rows"),
    ):
        path = str(tmp_path / message[:4])
        job.seed(spark, path, change, 4)
        with pytest.raises(gates.GateError, match=message):
            job.run(spark, path, feed, params, NOW, 4)


def test_bucketed_master_is_not_dealt(spark, root):
    """The plan of a run's join has an exchange on the feed's side only, also with the master's keys counted."""
    feed = typed(checked(fixtures.feed_raw(spark, BIG)), "row_num")
    d = reconcile.stored_compared(feed, *job.state(spark, root))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 1 and "FullOuter" in plan and "Bucketed: true" in plan
    assert d.count() == reconcile.compared(typed(checked(fixtures.feed_raw(spark, BIG))), fixtures.master(spark, BIG)).count()


# ---------------------------------------------------------------- landing


def test_landing(spark, tmp_path):
    """Wrong headers, cells and totals fail before any row is used, whichever file has them; below any Hadoop path."""
    rows = [("대전 서구", "a\tb", "line\none", "\\n", "셀프", "", "1,000", None), ("", "", "", "", "", "", "", ""), *(("r", str(i), "x", "", "일반", "-", "1", "2") for i in range(40))]
    feed = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in landing.HEADER.values())).coalesce(1)
    path = tmp_path / "in"
    landing.write_snapshots(feed, str(path))
    good = next(path.glob("part-*")).read_text()
    assert [tuple(r)[1:] for r in landing.landed(spark, str(path)).orderBy("row_num").collect()] == [tuple(x or "" for x in r) for r in rows]
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.land.link./in", f"file://{path}")
    assert landing.landed(spark, "viewfs://land/in").count() == len(rows)
    lines = good.splitlines()
    moved = "\n".join(["preamble", "", *lines]) + "\n"  # the header is found where it is
    assert landing.rows_of(moved.encode()) == landing.rows_of(good.encode())
    broken = {
        "declared": good.replace("일반", "", 1), "declared, ": "\n".join(lines[:-2] + lines[-1:]), "no control total": "\n".join(lines[:-1]), "0 headers": good.replace("지역", "지 역"), "2 headers": "\n".join([lines[1], *lines]),
        "9 cells in line 3": good.replace(lines[2], lines[2] + "\tx"), "1 cells": good.replace(lines[-2], "cut"),
    }
    for k, (message, text) in enumerate(broken.items()):
        own = tmp_path / f"b{k}"
        own.mkdir()
        (own / "a.txt").write_text(good)
        (own / "b.txt").write_text(text)
        with pytest.raises(landing.LandingError, match=message):
            landing.landed(spark, str(own))
    (own / "b.txt").write_bytes(b"\xff")
    with pytest.raises(landing.LandingError, match="b.txt: not UTF-8"):
        landing.landed(spark, str(own))
    (own / "b.txt").write_text(good)
    assert landing.landed(spark, str(own)).select(F.max("row_num")).first()[0] == 2 * len(rows)
    with pytest.raises(landing.LandingError, match="bytes"):
        landing.landed(spark, str(own), most_bytes=10)
    (tmp_path / "none").mkdir()
    with pytest.raises(landing.LandingError, match="no snapshot"):
        landing.landed(spark, str(tmp_path / "none"))


def test_landing_of_many_bytes(spark):
    """A feed of more bytes than three snapshots may have becomes more of them, with all its rows in their order."""
    rows = [(i, "대전", f"a\t{i}", "x\\" * (i % 40), "", "셀프", None, "1", "2") for i in range(3000)]
    feed = spark.createDataFrame(rows, "row_num long, " + ", ".join(f"{c} string" for c in landing.HEADER.values()))
    got = landing.relanded(feed.orderBy(F.rand(1)), "row_num", 20_000)
    assert [tuple(r) for r in got.orderBy("row_num").collect()] == [(i + 1, *(x or "" for x in r)) for i, *r in rows]
    assert landing.relanded(feed.where("row_num < 10"), "row_num").count() == 10


# ---------------------------------------------------------------- store


@pytest.mark.parametrize("kind", ["file", "viewfs"])
def test_two_committers(spark, tmp_path, kind):
    """Both begin at one version; the second to finish fails and leaves nothing. Below a local folder and any other Hadoop path."""
    root = str(tmp_path / "s")
    if kind == "viewfs":
        (tmp_path / "s").mkdir()
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lark.link./s", f"file://{tmp_path}/s")
        root = "viewfs://lark/s"
    assert store.commit(spark, root, {"t": spark.range(3)}) == 1
    inner = lambda _: store.commit(spark, root, {"t": spark.range(5)})  # noqa: E731  commits between the other's write and its manifest
    with pytest.raises(store.Conflict, match="version 2"):
        store.commit(spark, root, {"t": spark.range(9)}, verify=inner)
    assert store.current(spark, root)["number"] == 2 and store.read(spark, root, "t").count() == 5
    assert len(list((tmp_path / "s").glob("v-*"))) == 2
    with pytest.raises(RuntimeError, match="no"):
        store.commit(spark, root, {"t": spark.range(1)}, verify=lambda _: (_ for _ in ()).throw(RuntimeError("no")))
    assert store.current(spark, root)["number"] == 2 and len(list((tmp_path / "s").glob("v-*"))) == 2
    with store.run_lock(spark, root), pytest.raises(store.Conflict), store.run_lock(spark, root):
        pass
    with store.run_lock(spark, root):  # it was given back
        pass


def test_committers_at_once(spark, tmp_path):
    """Of many that create one manifest at the same time, one does."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        for k in range(10):
            assert sum(pool.map(lambda i, k=k: store.create_once(spark, str(tmp_path / "m" / f"{k}"), str(i)), range(8))) == 1


def test_broken_commit(spark, tmp_path):
    """A manifest that was begun and not finished: readers don't see it, committers wait for recover."""
    root = str(tmp_path)
    store.commit(spark, root, {"t": spark.range(3)})
    text = (tmp_path / "_versions" / "00000001").read_text()
    (tmp_path / "_versions" / "00000002").write_text(text[: len(text) // 2])
    assert store.read(spark, root, "t").count() == 3
    with pytest.raises(store.Conflict, match="recover"):
        store.commit(spark, root, {"t": spark.range(4)})
    store.recover(spark, root)
    assert store.commit(spark, root, {"t": spark.range(4)}) == 2 and store.read(spark, root, "t").count() == 4


def test_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else "x" * (i % 5), float(i)) for i in range(500)] + [(7, "dup", 1.0)] * 2, "a int, b string, c double")
    of = store.fingerprint_of(df)
    assert of == store.fingerprint_of(df.repartition(7).orderBy(F.desc("a")))
    changed = (df.where("a <> 3"), df.union(df.where("a = 3")), df.withColumn("b", F.coalesce("b", F.lit(""))), df.withColumn("c", F.when(F.col("a") == 9, 9.5).otherwise(F.col("c"))), df.where("not (b <=> 'dup')").union(df.where("a in (8, 9)")))
    assert all(store.fingerprint_of(x) != of for x in changed)
    swap = lambda *r: store.fingerprint_of(spark.createDataFrame(r, "a string, b string"))
    assert swap((None, "x")) != swap(("x", None)) and swap(("a", "b"), ("c", "d")) != swap(("a", "d"), ("c", "b"))
    store.commit(spark, str(tmp_path), {"t": df})
    store.verify_rows(spark, str(tmp_path))
    folder = next(tmp_path.glob("v-*")) / "t"
    part = next(folder.glob("part-*.parquet"))
    (folder / f"again-{part.name}").write_bytes(part.read_bytes())  # rows twice
    with pytest.raises(RuntimeError, match="isn't what was written"):
        store.verify_rows(spark, str(tmp_path))


# ---------------------------------------------------------------- check of a version


def test_check_of_a_master(spark, root):
    params = pricing.Params()
    job.run(spark, root, fixtures.feed_raw(spark, BIG), params, NOW, 4)
    good = stored_master(spark, root)
    verify.check(good, params)
    first, second = F.col("position") == 1, F.col("position") == 2
    cases = {
        "total_price": {"total_price": F.when(first, None).otherwise(F.col("total_price"))}, "gasoline": {"gasoline": F.when(first, F.col("gasoline") + 1).otherwise(F.col("gasoline"))}, "rank": {"rank": F.when(first, 2).otherwise(F.col("rank"))},
        "position": {"position": F.when(first, 2).otherwise(F.col("position"))}, "order": {"position": F.when(first, 900).when(F.col("position") == 900, 1).otherwise(F.col("position"))}, "fuel_total_text": {"fuel_total_text": F.when(second, "x").otherwise(F.col("fuel_total_text"))},
    }
    for what, change in cases.items():
        found = {r["what"]: r["n"] for r in verify.problems(good.withColumns(change), params).collect() if r["n"]}
        assert ("adj_gasoline" if what == "gasoline" else what) in found, (what, found)
        assert what in ("gasoline",) or len(found) == 1, (what, found)
    assert {r["what"] for r in verify.problems(good.where("position <> 5"), params).collect() if r["n"]} >= {"position"}
    assert all(r["n"] == 0 for r in verify.problems(good.where("false"), params).collect())


# ---------------------------------------------------------------- ratios and ranks


def ratio_of(n, d):
    """Long division and Python's exact decimals."""
    sign = "-" if n and (n < 0) != (d < 0) else ""
    n, d = abs(n), abs(d)
    whole, rest = divmod(n, d)
    text, digits = str(whole), ""
    while rest and len(digits) < 32:
        q, rest = divmod(rest * 10, d)
        digits += str(q)
    if not rest:
        return sign + text + ("." + digits if digits else "")
    head, exponent = f"{Decimal(float(f'{text}.{digits}')):.16e}".split("e")
    head, at = head.replace(".", ""), int(exponent) + 1
    out = f"0.{'0' * -at}{head}" if at <= 0 else head + "0" * (at - len(head)) if at >= len(head) else f"{head[:at]}.{head[at:]}"
    return sign + (out.rstrip("0").rstrip(".") if "." in out else out)


def test_ratio_text(spark):
    import random

    r = random.Random(1)
    cases = [(0, 5), (1, 3), (2, 3), (-1, 3), (1, -8), (10, 4), (10**20, 7), (1, 2**30), (10**28, 3 * 10**6), (1, 5**20), (1, 2**33), (1, 2**32), (1, 10**12)]
    cases += [(r.choice([1, -1]) * r.randint(1, 10 ** r.randint(1, 27)), r.choice([1, -1]) * r.randint(1, 10 ** r.randint(1, 11))) for _ in range(1000)]
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(cases)] + [(-1, None, "1"), (-2, "1", None)], "i int, a string, b string")
    got = {x["i"]: x["t"] for x in parse.with_ratio_text(df, "t", F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {i: ratio_of(*c) for i, c in enumerate(cases)}
    with pytest.raises(Exception, match="denominator of a ratio is zero"):
        parse.with_ratio_text(df.where("i = 0"), "t", F.col("a").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).collect()


def test_unit_texts_of_equal_totals(spark, monkeypatch):
    """Each different total is divided once; rows and their texts are those of dividing each row's."""
    divided, divide = [], pricing.with_ratio_text

    def counted(df, *args):
        divided.append(df.count())
        return divide(df, *args)

    monkeypatch.setattr(pricing, "with_ratio_text", counted)
    rows = spark.range(2000).selectExpr("id", "cast(if(id % 11 = 0, null, id % 7 * 1000.5) as decimal(28,12)) total_price", "cast(if(id % 11 = 0, null, id % 7 * 1000.5 - id % 3) as decimal(28,12)) regional_total")
    got = pricing.with_unit_texts(rows, pricing.Params()).collect()
    assert divided == [len({t for r in got for t in (r["total_price"], r["regional_total"]) if t is not None})] and divided[0] < 30
    assert sorted(r["id"] for r in got) == list(range(2000))
    for r in got:
        for name, total in (("unit_text_with", "regional_total"), ("unit_text_without", "total_price")):
            assert r[name] == (None if r[total] is None else ratio_of(int(r[total] * 10**12), 50 * 10**12))
    none = pricing.Params(quantity=dict.fromkeys(pricing.FUELS, Decimal(0)))
    assert {(r["unit_text_with"], r["unit_text_without"]) for r in pricing.with_unit_texts(rows, none).collect()} == {(None, None)}


def test_rank_of_a_million_decimals(spark):
    """Different keys lie in several ranges, and none of them holds most."""
    df = spark.range(1_000_000).selectExpr("id", "cast((id * 7919 % 1000000) / 100 - 3000 as decimal(28,12)) as t")
    got = reconcile.competition_rank(df, "t")
    assert got.where("rank <> id * 7919 % 1000000 + 1").count() == 0 and got.count() == 1_000_000
    ranges = spark.read.parquet(scratch._made[-1]).groupBy(F.shiftrightunsigned("at__", 33)).count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 400_000

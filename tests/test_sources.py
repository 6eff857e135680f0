import datetime as dt
import gzip
import math
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hearthline.plans import panels
from hearthline.plans import scenario as sc
from hearthline.plans.market import MarketData, Parameters, Sources
from hearthline.sources import files, tpch
from helpers import month_ends

D = dt.date
SF = "/root/testdata/sf0.001"


def write(path, text):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


def test_weekly_rate_with_dates_parsed(spark, tmp_path):
    path = write(tmp_path / "rate.csv", "DATE,MORTGAGE30US\n2011-01-06,4.77\n2011-01-13,\n")
    df = files.mortgage_rate(spark, path)
    assert df.dtypes == [("DATE", "date"), ("MORTGAGE30US", "double")]
    assert [tuple(r) for r in df.collect()] == [(D(2011, 1, 6), 4.77), (D(2011, 1, 13), None)]


def test_other_date_formats_are_declared(spark, tmp_path):
    path = write(tmp_path / "rate.csv", "DATE,MORTGAGE30US\n06/01/2011,4.77\n")
    df = files.read_csv(spark, path, files.MORTGAGE_RATE, date_format="dd/MM/yyyy")
    assert df.first().DATE == D(2011, 1, 6)


@pytest.mark.parametrize("name", ["county.csv", "county.csv.gz"])
def test_columns_are_found_by_name_whatever_their_order(spark, tmp_path, name):
    measures = [f"Median{kind}Price_{r}Bedroom" for kind in ("Rental", "Listing") for r in (4, 3, 2, 1)]
    header = ",".join(["Unused", "RegionName", *measures, "Date"])
    path = write(tmp_path / name, f"{header}\nx,25017,40,30,20,10,4,3,2,NaN,2011-01-31\n")
    row = files.county_panel(spark, path).first()
    assert (row.Date, row.RegionName) == (D(2011, 1, 31), 25017)
    assert row.MedianRentalPrice_1Bedroom == 10 and row.MedianListingPrice_4Bedroom == 4
    assert row.MedianListingPrice_1Bedroom is None  # NaN is missing


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "rate.csv", "DATE,OTHER\n2011-01-06,1\n")
    with pytest.raises(AnalysisException):
        files.mortgage_rate(spark, path)


def test_nan_in_parquet_becomes_null(spark, tmp_path):
    path = str(tmp_path / "fmr")
    row = [(D(2011, 10, 1), 1, math.nan, 2.0, 3.0, 4.0)]
    spark.createDataFrame(row, files.FAIR_RENT).write.parquet(path)
    assert files.fair_rent(spark, path).first().fmr_1 is None


def test_rewrite_by_year_keeps_rows_and_skips_years(spark, tmp_path):
    path = str(tmp_path / "by_year")
    rows = [(d, i, float(i)) for i, d in enumerate(month_ends("2010-01-31", 36) * 3)]
    df = spark.createDataFrame(rows, "Date date, RegionName int, x double")
    files.write_by_year(df, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.drop("year").collect())) == sorted(map(tuple, df.collect()))
    plan = back.filter("year = 2011")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert len(list((tmp_path / "by_year" / "year=2011").glob("*.parquet"))) <= 2


def test_panel_stored_by_year_skips_the_years_before(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [(d, 1, *[1.0] * 8) for d in month_ends("2009-01-31", 48)]
    files.write_by_year(spark.createDataFrame(rows, files.COUNTY_PANEL), path)
    panel = panels.recent_panel(files.read_parquet(spark, path, files.COUNTY_PANEL), 2011)
    assert panel.columns == files.COUNTY_PANEL.names and panel.count() == 24
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThanOrEqual(Date,2011-01-01)" in plan


def test_cells_equal_plain_counting(spark):
    cells = tpch.order_cells(spark, SF)
    orders = tpch.table(spark, SF, "orders")
    total = cells.agg(F.sum("orders"), F.sum("amount") * 100).first()
    plain = orders.agg(F.count("*"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))).first()
    assert tuple(total) == tuple(plain)
    per_room = cells.agg(*[F.sum(f"orders_{r}") for r in range(1, 5)]).first()
    rooms = orders.filter("substring(o_orderpriority, 1, 1) BETWEEN '1' AND '4'").count()
    assert sum(per_room) == rooms


def test_cells_since_a_day_equal_the_filtered_cells(spark):
    since = tpch.order_cells(spark, SF, since=D(1998, 1, 1), rents=False)
    later = tpch.order_cells(spark, SF, rents=False).filter(F.col("month_end") >= D(1998, 1, 1))
    assert sorted(map(tuple, since.collect()), key=str) == sorted(map(tuple, later.collect()), key=str)


def test_amounts_that_are_not_numbers_are_missing(spark, tmp_path):
    day = dt.datetime(1999, 5, 3)
    orders = [(1, 1, 10.0, day, "1-URGENT"), (2, 1, math.nan, day, "1-URGENT"), (3, 1, None, day, "2-HIGH"), (4, 1, 30.0, day, "x")]
    lines = [(1, 2.0, 9.0, math.nan, day), (1, math.nan, 1.0, 0.04, day), (2, 4.0, math.inf, None, day)]
    tables = {"orders": orders, "lineitem": lines, "customer": [(1, 5)]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, tpch.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    (cell,) = tpch.order_cells(spark, str(tmp_path)).collect()
    assert (cell.nation, cell.month_end) == (5, D(1999, 5, 31))
    assert (cell.orders, cell.amount) == (2, 40)  # the unreadable priority still counts in the total
    assert (cell.orders_1, cell.amount_1, cell.rents_1, cell.rent_total_1) == (1, 10, 1, 5.0)
    panel = tpch.county_panel(tpch.order_cells(spark, str(tmp_path))).first()
    assert panel.MedianListingPrice_1Bedroom == 10.0 and panel.MedianListingPrice_2Bedroom is None
    (week,) = tpch.rate_weekly(spark, str(tmp_path)).collect()
    assert (week.DATE, week.MORTGAGE30US) == (D(1999, 5, 3), 4.0)


def test_amounts_keep_every_place(spark, tmp_path):
    """Thousandths, and sums of hundreds of billions of them, are exact."""
    day = dt.datetime(1999, 5, 3)
    prices = [0.125, 0.001, 1e17, 123456789012.345, -0.004, 1e300]
    tables = {
        "orders": [(k, 1, p, day, "1-URGENT") for k, p in enumerate(prices)],
        "lineitem": [(1, 1.0, 0.0005, 0.12345, day), (1, 1.0, 1e15, 0.00005, day), (1, 1.0, -1e15, None, day)],
        "customer": [(1, 5)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, tpch.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    (cell,) = tpch.order_cells(spark, str(tmp_path)).collect()
    assert (cell.orders_1, cell.amount_1) == (5, sum(Decimal(repr(p)) for p in prices[:-1]))
    assert cell.rent_total_1 == 0.0005 / 3
    (week,) = tpch.rate_weekly(spark, str(tmp_path)).collect()
    assert week.MORTGAGE30US == pytest.approx(12.35 / 2, abs=1e-12)


def test_facts_in_buckets_meet_without_a_shuffle(spark, tmp_path):
    store = tpch.store_facts(spark, SF, str(tmp_path / "facts"))
    panel = tpch.county_panel(tpch.order_cells(spark, SF, stored=store))
    plain = tpch.county_panel(tpch.order_cells(spark, SF))
    shown = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert shown(panel) == shown(plain)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = lambda df: df._jdf.queryExecution().executedPlan().toString()
        stored, read = (keyed(tpch.order_cells(spark, SF, stored=s)) for s in (store, None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = "Exchange hashpartitioning({}"
    assert moved.format("o_orderkey") in read and moved.format("l_orderkey") in read
    assert moved.format("o_orderkey") not in stored and moved.format("l_orderkey") not in stored
    assert stored.count("Bucketed: true") == 2
    assert len(list((tmp_path / "facts" / "orders-8").glob("*.parquet"))) == 8
    with pytest.raises(Exception, match="exist"):
        tpch.store_facts(spark, SF, str(tmp_path / "facts"))
    for name in ("orders", "line_sums"):  # as in a session that didn't write them
        spark.sql(f"DROP TABLE {store._name(name)}")
    assert shown(tpch.county_panel(tpch.order_cells(spark, SF, stored=store))) == shown(plain)


def test_one_customer_and_one_order_with_a_third_of_the_rows(spark, tmp_path):
    """Hot keys give the same cells as plain counting over the same rows."""
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "lineitem", "customer")}
    tables["orders"] = tables["orders"].withColumn("o_custkey", F.expr("if(o_orderkey % 3 = 0, 7, o_custkey)"))
    tables["lineitem"] = tables["lineitem"].withColumn("l_orderkey", F.expr("if(l_partkey % 3 = 0, 11, l_orderkey)"))
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = tpch.order_cells(spark, str(tmp_path)).toPandas().set_index(["nation", "month_end"]).sort_index()

    orders, lines, customers = (tables[n].toPandas() for n in ("orders", "lineitem", "customer"))
    unit = lines.groupby("l_orderkey")[["l_extendedprice", "l_quantity"]].sum()
    orders = orders.merge(customers[["c_custkey", "c_nationkey"]], left_on="o_custkey", right_on="c_custkey")
    orders["unit"] = orders.o_orderkey.map(unit.l_extendedprice / unit.l_quantity)
    orders["month_end"] = (orders.o_orderdate + pd.offsets.MonthEnd(0)).dt.date
    orders["rooms"] = orders.o_orderpriority.str[0].astype(int)
    groups = orders.groupby(["c_nationkey", "month_end"])
    assert len(got) == len(groups)
    assert got.orders.tolist() == groups.size().tolist()
    assert got.amount.astype(float).tolist() == pytest.approx(groups.o_totalprice.sum().tolist())
    for r in range(1, 5):
        room = orders[orders.rooms == r].groupby(["c_nationkey", "month_end"])
        mine = got[got[f"orders_{r}"] > 0]
        assert mine[f"orders_{r}"].tolist() == room.size().tolist()
        assert mine[f"rents_{r}"].tolist() == room.unit.count().tolist()
        assert mine[f"rent_total_{r}"].fillna(0).tolist() == pytest.approx(room.unit.sum().tolist())


@pytest.fixture(scope="module")
def area(spark, tmp_path_factory):
    """A small area in the original file formats: four counties, seven years."""
    folder = tmp_path_factory.mktemp("area")
    months = month_ends("2011-01-31", 84)
    kinds = [(f"Median{k}Price_{r}Bedroom", b, s, r) for k, b, s in (("Listing", 2e5, 900.0), ("Rental", 1000.0, 4.0)) for r in range(1, 5)]
    lines = ["Date,RegionName," + ",".join(k for k, *_ in kinds)]
    for i, d in enumerate(months):
        for county in (25001, 25003, 25005, 25007):
            wave = 1 + 0.03 * ((d.month + county) % 5 - 2) / 2
            lines.append(f"{d},{county}," + ",".join(f"{(b * r + s * i) * wave:.2f}" for _, b, s, r in kinds))
    panel = write(folder / "county.csv.gz", "\n".join(lines) + "\n")

    codes = "FIPS code,State Abr.,County name,CBSA title,CBSA 2012 pop,County 2012 pop,2013 code,2006 code,1990-based code\n"
    codes += "".join(f"{c},{s},n{c},t,1,1,{u},1,1\n" for c, s, u in ((25001, "MA", 1), (25003, "MA", 2), (25005, "MA", 3), (25007, "MA", 4), (9001, "CT", 1)))
    weeks = [D(2000, 1, 6) + dt.timedelta(7 * i) for i in range(52 * 19)]
    rate = "DATE,MORTGAGE30US\n" + "".join(f"{d},{6 - i * 0.002 + 0.2 * (i % 7 - 3) / 3:.4f}\n" for i, d in enumerate(weeks))
    index = "hpi_type,hpi_flavor,frequency,level,place_name,place_id,yr,period,index_nsa,index_sa\n"
    for i in range(12 * 19):
        y, m = divmod(i, 12)
        value = 100 + 0.7 * i + 3 * ((i * 7) % 11 - 5) / 5
        index += f"traditional,purchase-only,monthly,x,New England Division,NE,{2000 + y},{m + 1},{value},{value}\n"
    fmr = str(folder / "fmr.parquet")
    rows = [(D(y, 10, 1), c, *[800.0 * r + 20.0 * (y - 2000) + c % 10 for r in range(1, 5)]) for y in range(2000, 2019) for c in (25001, 25003, 25005)]
    spark.createDataFrame(rows, files.FAIR_RENT).write.parquet(fmr)
    sources = Sources.from_files(
        spark, rate=write(folder / "rate.csv", rate), index=write(folder / "index.csv", index),
        panel=panel, codes=write(folder / "codes.csv", codes), fair_rent=fmr,
    )
    return MarketData(sources, Parameters("MA", "New England Division"), keep=lambda df: df.cache())


def test_defaults_are_the_published_analysis():
    p = Parameters("MA", "New England Division")
    assert (p.state, p.place, p.min_year, p.features_before) == ("MA", "New England Division", 2011, 2018)
    assert p.excluded_cell == {"last_year": 2012, "rooms": 1, "urban_code": 2}
    assert p.scenario == sc.Scenario("2016-01-01", "2012-01-01", "2013-01-01", "2018-01-01", 120, 60, 8.0, "2018-01-31")


def test_files_to_best_date(area):
    """The whole way from source files to a date, with fitted models."""
    prices, rents = area.price_model.fit_all(), area.rent_model.fit_all()
    prices, rents = prices.cache(), rents.cache()
    assert prices.count() == 12 and rents.count() == 12
    features = area.features.orderBy("month_end").collect()
    assert features[0].month_end == D(2000, 9, 30) and features[-1].month_end == D(2017, 12, 31)

    outlook = area.outlook(prices, rents, [0, 85])
    assert outlook.macro.count() == 2 * (len(features) + 120)
    assert area.rent_targets.filter("rooms = 1 AND urban_code = 2 AND month_end < DATE'2013-01-01'").count() == 0
    actual = area.prices_with_actuals(outlook).filter("target IS NOT NULL AND dip = 0")
    assert actual.count() == 84 * 12
    best = area.best_date(outlook, "2018-12-31", buy=(1, 2), rent=(1, 2)).collect()
    assert [r.dip for r in sorted(best)] == [0.0, 85.0]
    assert all(D(2018, 12, 31) < r.best_date <= D(2027, 12, 31) for r in best)
    flat, dipped = (area.best_date(outlook, "2018-12-31", buy=(1, 4), rent=(1, 1)).orderBy("dip").collect())
    assert dipped.total_cost_kusd <= flat.total_cost_kusd + 1e-9
    assert area.scenario_grid(outlook, "2018-12-31").count() == 2 * 12 * 12

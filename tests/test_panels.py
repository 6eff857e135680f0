import datetime as dt

import pytest

from hearthline.operators import relational
from hearthline.plans import panels
from helpers import column, month_ends

D = dt.date
PANEL = (
    "Date date, RegionName int, "
    + ", ".join(f"MedianListingPrice_{r}Bedroom double" for r in range(1, 5)) + ", "
    + ", ".join(f"MedianRentalPrice_{r}Bedroom double" for r in range(1, 5))
)
INDEX = (
    "hpi_type string, hpi_flavor string, frequency string, place_name string, yr int, period int, "
    "index_sa double, index_nsa double"
)


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("traditional", "purchase-only", "monthly", "East", 2011, 2, 100.0, 101.0),
        ("traditional", "purchase-only", "monthly", "West", 2011, 2, 200.0, 201.0),
        ("traditional", "purchase-only", "quarterly", "East", 2011, 2, 300.0, 301.0),
        ("traditional", "all-transactions", "monthly", "East", 2011, 2, 400.0, 401.0),
        ("other", "purchase-only", "monthly", "East", 2011, 2, 500.0, 501.0),
    ]
    return spark.createDataFrame(rows, INDEX)


@pytest.fixture(scope="module")
def dim(spark):
    codes = spark.createDataFrame(
        [(1, 1, "MA", "A", "x"), (2, 1, "MA", "B", "x"), (3, 2, "MA", "C", "x"), (4, 4, "MA", "D", "x"),
         (5, 1, "NH", "E", "x"), (6, 3, "MA", "F", "x")],
        "`FIPS code` int, `2013 code` int, `State Abr.` string, `County name` string, `CBSA title` string",
    )
    return panels.county_dim(codes, "MA")


def row(date, region, price=None, rent=None, price2=None):
    return (date, region, price, price2, None, None, rent, None, None, None)


@pytest.fixture(scope="module")
def panel(spark):
    jan, feb = D(2013, 1, 31), D(2013, 2, 28)
    rows = [
        row(jan, 1, 100.0, 10.0, 7.0), row(feb, 1, None, 12.0),
        row(jan, 2, 300.0, 30.0), row(feb, 2, 500.0, None),
        row(jan, 3, 50.0, 5.0),
        row(jan, 4, 60.0, 6.0),
        row(jan, 5, 70.0, 7.0),  # another state
        row(jan, 6, 80.0, None),  # never rented
        row(D(2010, 12, 31), 6, 80.0, 8.0),  # rented only before the first year
        (None, 1, 1e9, *[None] * 7),
    ]
    return panels.recent_panel(spark.createDataFrame(rows, PANEL), 2011)


def test_index_of_one_place_takes_monthly_purchase_rows_only(index):
    (r,) = panels.index_series(index, "East").collect()
    assert (r.month_end, r.hpi_sa, r.hpi_nsa) == (D(2011, 2, 28), 100.0, 101.0)


def test_index_without_a_place_still_takes_monthly_rows_unless_asked(index):
    assert {r.hpi_sa for r in panels.index_series(index).collect()} == {100.0, 200.0}
    assert {r.hpi_sa for r in panels.index_series(index, frequency=None).collect()} == {100.0, 200.0, 300.0}


def test_dimension_keeps_one_state_and_its_four_columns(dim):
    assert dim.columns == ["RegionName", "urban_code", "state", "county_name"]
    assert sorted(r.RegionName for r in dim.collect()) == [1, 2, 3, 4, 6]


def test_counties_need_both_measures_once_in_the_years_kept(panel, dim):
    counts = {r.RegionName: tuple(r)[1:] for r in panels.region_counts(panel, dim).collect()}
    assert counts == {1: (1, 2), 2: (2, 1), 3: (1, 1), 4: (1, 1), 6: (1, 0)}
    eligible = panels.eligible_regions(panel, dim)
    assert eligible.columns == dim.columns
    assert sorted(r.RegionName for r in eligible.collect()) == [1, 2, 3, 4]


def test_eligibility_looks_at_one_bedroom_columns_only(panel, dim):
    """Other columns of a kept county may still be empty."""
    means = panels.region_panel(panel, panels.eligible_regions(panel, dim))
    assert all(r.MedianListingPrice_3Bedroom is None for r in means.collect())


def test_means_are_unweighted_skip_missing_and_lose_rows_without_a_date(panel, dim):
    means = panels.region_panel(panel, panels.eligible_regions(panel, dim))
    got = {(r.month_end, r.urban_code): (r.MedianListingPrice_1Bedroom, r.MedianRentalPrice_1Bedroom) for r in means.collect()}
    assert got == {
        (D(2013, 1, 31), 1): (200.0, 20.0),
        (D(2013, 2, 28), 1): (500.0, 12.0),
        (D(2013, 1, 31), 2): (50.0, 5.0),
        (D(2013, 1, 31), 4): (60.0, 6.0),
    }
    assert "RegionName" not in means.columns


def test_price_targets_are_in_thousands_and_rents_are_not(panel, dim):
    means = panels.region_panel(panel, panels.eligible_regions(panel, dim))
    prices = {(r.month_end, r.urban_code, r.rooms): r.target for r in panels.price_targets(means).collect()}
    assert prices[D(2013, 1, 31), 1, 1] == 0.2 and prices[D(2013, 1, 31), 1, 2] == 0.007
    assert len(prices) == 5
    rents = {(r.urban_code, r.rooms, r.month_end): r.target for r in panels.rent_targets(means).collect()}
    assert rents[1, 1, D(2013, 2, 28)] == 12.0


def test_sparse_cell_is_dropped_through_its_last_year(spark):
    rows = [(D(y, 6, 30), c, r, 1.0) for y in (2012, 2013) for c in (1, 2) for r in (1, 2)]
    df = spark.createDataFrame(rows, "month_end date, urban_code int, rooms int, target double")
    kept = relational.without_cell(df, last_year=2012, rooms=1, urban_code=2)
    assert {tuple(r)[:3] for r in df.collect()} - {tuple(r)[:3] for r in kept.collect()} == {(D(2012, 6, 30), 2, 1)}


def test_codes_without_a_density_keep_their_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,), (None,)], "urban_code int")
    got = {r.urban_code: r.density for r in relational.with_density(df).collect()}
    assert got == {1: "urban", 2: "suburb", 3: "rural", 4: None, 6: None, None: None}


def test_fair_rent_is_rolled_back_averaged_and_spread(spark, dim):
    schema = "Date date, fips_simple int, fmr_1 double, fmr_2 double, fmr_3 double, fmr_4 double"
    rows = [
        (D(2011, 10, 1), 1, 100.0, 200.0, 300.0, 400.0), (D(2011, 10, 1), 2, 300.0, 400.0, 500.0, 600.0),
        (D(2012, 10, 1), 1, 320.0, 420.0, 520.0, 620.0), (D(2012, 10, 1), 2, 320.0, 420.0, 520.0, 620.0),
        (D(2011, 10, 1), 4, 9e9, 9e9, 9e9, 9e9),  # a code without a density
    ]
    monthly = panels.fair_rent_monthly(spark.createDataFrame(rows, schema), dim)
    one = monthly.filter("urban_code = 1 AND rooms = 1")
    assert column(one, "month_end") == month_ends("2011-09-30", 13)
    assert column(one, "fmr") == pytest.approx([200.0 + 10 * i for i in range(13)])
    assert monthly.filter("urban_code = 4").count() == 0
    assert column(panels.fair_rent_index(monthly), "fmr") == pytest.approx([350.0 + 10 * i for i in range(13)])


def test_every_market_is_twelve_rows(spark):
    out = relational.every_market(spark.range(3))
    assert out.count() == 36 and out.select("urban_code", "rooms").distinct().count() == 12

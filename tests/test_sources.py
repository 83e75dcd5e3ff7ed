"""Readers and writers at their real sizes: a matrix of 1,275 tickers, 19 yearly files, tables in buckets."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelscope.operators import detectors, features, panel
from panelscope.sources import prices

DAY = date(2020, 1, 1)

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def names(n):
    return [f"T{k}/A LN" if k % 40 == 0 else f"X.{k} FP" if k % 40 == 1 else f"N{k} GY" for k in range(n)]


def test_matrix_of_full_width(spark, tmp_path):
    tickers = names(1275)
    assert len(set(tickers)) == 1275
    rng = random.Random(1)
    cells = {(d, k): rng.randrange(1, 10**6) / 100 for d in range(4) for k in range(len(tickers)) if rng.random() < 0.6}
    lines = [",".join([str(DAY + timedelta(d)), *[str(cells.get((d, k), "")) for k in range(len(tickers))]]) for d in range(4)]
    (tmp_path / "wide.csv").write_text("\n".join([",".join(["Ticker", *tickers]), *lines]))
    made = panel.wide_to_long(prices.read_wide(spark, str(tmp_path / "wide.csv")))
    got = {((r["date"] - DAY).days, r["ticker"]): r["price"] for r in made.collect()}
    assert got == {(d, tickers[k]): v for (d, k), v in cells.items()}
    few = plan_of(panel.wide_to_long(spark.createDataFrame([(DAY, 1.0, 2.0)], "date date, `A LN` double, `B/C FP` double")))
    many = plan_of(panel.wide_to_long(spark.createDataFrame([(DAY, *[1.0] * 1275)], "date date, " + ", ".join(f"`{t}` double" for t in tickers))))
    assert many.count("Generate") == 1 and "Expand" not in many and len(many.splitlines()) == len(few.splitlines())


def test_columns_with_odd_names(spark):
    wide = spark.createDataFrame([(DAY, 1, None, 3.0)], "date date, `a.b` int, `c``d` double, `e/f GA` double")
    assert sorted((r["ticker"], r["price"]) for r in panel.wide_to_long(wide).collect()) == [("a.b", 1.0), ("e/f GA", 3.0)]
    assert panel.wide_to_long(wide.select("date")).count() == 0


def test_yearly_files_are_one_scan(spark, tmp_path):
    rng, want = random.Random(2), set()
    paths = []
    for year in range(2002, 2021):
        tickers = rng.sample([f"T{k} LN" for k in range(30)], rng.randrange(3, 12))
        lines = [",".join(["Date", *[f'"{t}"' if rng.random() < 0.3 else t for t in tickers]])]
        for day in range(5):
            d = date(year, 1, 1) + timedelta(day)
            values = [rng.choice(["", "NaN", "n/a", None, None, None, None]) for _ in tickers]
            values = [str(rng.randrange(1, 1000) / 8) if v is None else v for v in values]
            want |= {(d, t, float(v)) for t, v in zip(tickers, values) if v not in ("", "NaN", "n/a")}
            lines.append(",".join([str(d), *values]))
        path = tmp_path / f"prices_{year}.csv"
        path.write_text(("\r\n" if year % 2 else "\n").join(lines) + "\n")
        paths.append(str(path))
    made = prices.read_yearly(spark, paths)
    assert {tuple(r) for r in made.collect()} == want and made.count() == len(want)
    plan = plan_of(prices.read_yearly(spark, paths))
    assert plan.count("FileScan") == 1 and plan.count("Union") == 0
    (tmp_path / "prices_2021.csv").write_text("Date,T1 LN\n")
    assert prices.read_yearly(spark, [str(tmp_path / "prices_2021.csv")]).count() == 0 and prices.read_yearly(spark, []).count() == 0


@pytest.fixture
def stored(spark):
    rng = random.Random(3)
    rows = [(DAY + timedelta(7 * t), f"T{k} LN", 100 + rng.random()) for k in range(20) for t in range(80)]
    df = spark.createDataFrame(rows, "date date, ticker string, price double")
    spark.sql("drop table if exists stored_panel")
    prices.write_bucketed(df, "stored_panel", 4)
    yield df
    spark.sql("drop table stored_panel")


def test_buckets_need_no_exchange(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = prices.read_bucketed(spark, "stored_panel")
        returns = detectors.simple_returns(back)
        for made in (features.add_features(back), detectors.detect_cusum(returns), detectors.detect_jump(returns), detectors.zscores(returns, 20)):
            assert plan_of(made).count("Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = features.add_features(stored).select("ticker", "date", F.round("20d_vol", 9)).collect()
    assert sorted(want) == sorted(features.add_features(prices.read_bucketed(spark, "stored_panel")).select("ticker", "date", F.round("20d_vol", 9)).collect())


def test_single_years_are_rewritten(spark, stored, tmp_path):
    new = stored.where("year(date) = 2020").withColumn("price", F.lit(1.0))
    expect = stored.where("year(date) <> 2020").unionByName(new)
    prices.rewrite_years(new, "stored_panel")
    back = prices.read_bucketed(spark, "stored_panel").select("date", "ticker", "price")
    assert back.exceptAll(expect).count() == 0 and back.count() == expect.count()
    assert plan_of(detectors.simple_returns(back)).count("Exchange") == 0
    prices.write_table(stored, str(tmp_path / "y"), by_year=True)
    prices.write_table(new, str(tmp_path / "y"), by_year=True)
    assert spark.read.parquet(str(tmp_path / "y")).select("date", "ticker", "price").exceptAll(expect).count() == 0

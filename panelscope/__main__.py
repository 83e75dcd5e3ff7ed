"""Command line: build (prices to a feature panel), cpd (a panel to changepoint scores), train (a position model for a fold),
backtest (momentum positions by fold)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators import backtest, detectors, features, gaussian, momentum, panel, training
from panelscope.schema import Config
from panelscope.sources import prices


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    c = a.config
    workbook = a.prices.endswith((".xlsx", ".xls"))
    if a.benchmark or workbook:
        _, long, both = prices.load_market(spark, a.prices, a.benchmark, a.date_column)
        prices.write_table(both, f"{a.out_dir}/benchmarks.parquet")
    else:
        long = panel.add_country_region(panel.normalised(panel.wide_to_long(prices.read_wide(spark, a.prices, a.date_column))))
    if c.assets:
        long = long.where(F.col("ticker").isin(*c.assets))
    prices.write_table(features.add_features(long, c.return_horizons, c.vol_windows), f"{a.out_dir}/panel.parquet", by_year=True)


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    return prices.read_processed(spark, f"{folder}/panel.parquet", ("date", "ticker", "price"))


def cpd(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores of daily log returns for each lookback, labelled with the last date of the window."""
    daily = _panel(spark, a.in_dir).withColumn("r", features.log_return(1))
    returns = detectors.simple_returns(daily).drop("r").join(daily.select("ticker", "date", "r"), ["ticker", "date"])
    for k in a.lbw or [a.config.lbw]:
        prices.write_table(gaussian.gp_scores(returns, k, a.stride).withColumn("lbw", F.lit(k)), f"{a.out_dir}/cpd_{k}.parquet")


def run_train(spark: SparkSession, a: argparse.Namespace) -> None:
    """A position model trained on the Sharpe ratio of all rows before the fold, and its positions in the fold."""
    data = momentum.model_inputs(_panel(spark, a.data_dir), a.config.macd_pairs, span=a.config.ewm_span, target=a.config.vol_target)
    rows = backtest.fold_rows(data, backtest.folds(spark, a.start, a.first_test, a.end).where(F.col("fold") == a.fold))
    features_ = tuple(c for c in data.columns if c.startswith(("norm_", "macd_")))
    model = training.train(rows.where("part = 'train'"), features_, a.steps)
    held = rows.where("part = 'test'").select("fold", "ticker", "date", model.position().alias("position"), "r")
    prices.write_table(held, f"{a.data_dir}/positions_{a.fold}.parquet")
    names = ["bias", *features_]
    weights = [(n, c, s, w) for n, c, s, w in zip(names, (0.0, *model.centre), (1.0, *model.scale), model.weights)]
    prices.write_table(spark.createDataFrame(weights, "feature string, centre double, scale double, weight double"), f"{a.data_dir}/model_{a.fold}.parquet")


def run_backtest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of volatility-scaled time-series momentum over the test years of each fold."""
    data = _panel(spark, a.data_dir)
    position = momentum.tsmom_position(data, a.weight).withColumn("position", F.lag("position").over(momentum._by_t()))
    returns = detectors.simple_returns(data)
    scaled = returns.join(momentum.vol_scaled(returns, a.config.vol_target, a.config.ewm_span), ["ticker", "t"])
    held = scaled.join(position.select("ticker", (F.col("t") - 1).alias("t"), "position"), ["ticker", "t"]).withColumn("r", F.col("position") * F.col("scaled"))
    tests = backtest.fold_rows(held.select("ticker", "date", "t", "r"), backtest.folds(spark, a.start, a.first_test, a.end)).where("part = 'test' and r is not null")
    daily = tests.groupBy("fold", "date").agg(F.avg("r").alias("r")).withColumn("t", F.unix_date("date"))
    prices.write_table(momentum.portfolio_metrics(daily, "fold"), f"{a.data_dir}/backtest.parquet")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="panelscope", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config", type=Config.read, default=Config(), help="YAML or JSON file of parameters")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("build", parents=[common])
    p.add_argument("--prices", required=True)
    p.add_argument("--benchmark")
    p.add_argument("--date-column", default="Ticker")
    p.add_argument("--out-dir", required=True)
    p.set_defaults(run=build)
    p = sub.add_parser("cpd", parents=[common])
    p.add_argument("--lbw", type=int, nargs="+")
    p.add_argument("--stride", type=int, default=1)
    p.add_argument("--in-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.set_defaults(run=cpd)
    p = sub.add_parser("backtest", parents=[common])
    p.add_argument("--data-dir", required=True)
    p.add_argument("--weight", type=float, default=0.0)
    for name, year in (("start", 1990), ("first-test", 1995), ("end", 2020)):
        p.add_argument(f"--{name}", type=int, default=year)
    p.set_defaults(run=run_backtest)
    p = sub.add_parser("train", parents=[common])
    p.add_argument("--fold", type=int, default=0)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--steps", type=int, default=20)
    for name, year in (("start", 1990), ("first-test", 1995), ("end", 2020)):
        p.add_argument(f"--{name}", type=int, default=year)
    p.set_defaults(run=run_train)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("panelscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()

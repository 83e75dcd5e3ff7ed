"""Readers and writers of price tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.operators.benchmarks import equal_weight_index, stacked
from panelscope.operators.panel import add_country_region, normalised, wide_to_long


def read_wide(spark: SparkSession, path: str, date_column: str = "Ticker") -> DataFrame:
    """A wide price matrix (CSV with a header, or Parquet): a date column, then one column for each ticker."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    prices = [F.col(f"`{c}`").cast("double").alias(c) for c in df.columns if c != date_column]
    return df.select(F.to_date(F.col(f"`{date_column}`")).alias("date"), *prices)


def read_excel_wide(spark: SparkSession, path: str, sheet: str = "price", date_column: str = "Ticker") -> DataFrame:
    """The wide matrix of a workbook's sheet. Workbooks are read by pandas, which needs openpyxl, on the driver:
    a sheet has a million rows at most. Larger inputs are CSV or Parquet."""
    import pandas as pd

    found = pd.read_excel(path, sheet_name=sheet).rename(columns={date_column: "date"})
    return spark.createDataFrame(found.assign(date=pd.to_datetime(found["date"]).dt.date))


def read_benchmark(spark: SparkSession, path: str, name: str = "SXXR") -> DataFrame:
    """(date, benchmark, price) of a table with Date and price: CSV, Parquet, or the workbook's sheet `benchmark`."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        found = pd.read_excel(path, sheet_name="benchmark")
        df = spark.createDataFrame(found[["Date", "price"]].assign(Date=pd.to_datetime(found["Date"]).dt.date))
    else:
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return df.select(F.to_date("Date").alias("date"), F.lit(name).alias("benchmark"), F.col("price").cast("double").alias("price"))


def load_market(spark: SparkSession, prices: str, benchmark: str | None = None, date_column: str = "Ticker") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide, long, benchmarks) from a workbook, or from two tables: the date by ticker matrix, the long panel with
    exchange, country and region, and the given benchmark stacked on the equal-weight index."""
    wide = read_excel_wide(spark, prices, date_column=date_column) if prices.endswith((".xlsx", ".xls")) else read_wide(spark, prices, date_column)
    long = normalised(wide_to_long(wide))
    given = read_benchmark(spark, benchmark or prices)
    return wide, add_country_region(long), stacked(given, equal_weight_index(long))


def _fields(line: Column) -> Column:
    """The fields of a line of CSV; quotes around a field are taken off, and fields hold no commas, being tickers and numbers."""
    return F.transform(F.split(line, ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))


def read_yearly(spark: SparkSession, paths: list[str], date_column: str = "Date") -> DataFrame:
    """The long panel (date, ticker, price) of wide CSV files, one for each year. Files may list different tickers, in any order:
    a value goes by its place in the header of its own file.

    All files are one scan of lines. The headers, one line a file, are found by the date column's name and broadcast;
    fields that are missing or no numbers, and those beyond the header, give no row.
    """
    made = "date date, ticker string, price double"
    if not paths:
        return spark.createDataFrame([], made)
    lines = spark.read.text(sorted(paths)).select(F.col("_metadata.file_path").alias("file"), _fields(F.col("value")).alias("fields"))
    is_header = F.col("fields")[0] == date_column
    headers = lines.where(is_header).groupBy("file").agg(F.first("fields").alias("names")).collect()
    known = spark.createDataFrame([(r["file"], r["names"]) for r in headers], "file string, names array<string>")
    rows = lines.where(~is_header).join(F.broadcast(known), "file")
    each = rows.select(F.expr("try_cast(fields[0] as date)").alias("date"), F.explode(F.arrays_zip(F.col("names"), F.col("fields"))).alias("x"))
    each = each.select("date", F.col("x.names").alias("ticker"), F.expr("try_cast(x.fields as double)").alias("price"))
    return each.where(F.col("date").isNotNull() & F.col("ticker").isNotNull() & (F.col("ticker") != date_column) & F.col("price").isNotNull() & ~F.isnan("price"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker) from the header of a file that may have no rows."""
    names = spark.read.csv(path, header=True).columns[1:]
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def read_universe_by_year(spark: SparkSession, path: str) -> DataFrame:
    """(year, ticker) from a JSON object that maps years to lists of symbols."""
    text = spark.read.text(path, wholetext=True)
    years = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("year", "tickers"))
    return years.select(F.col("year").cast("int").alias("year"), F.explode("tickers").alias("ticker"))


def read_processed(spark: SparkSession, path: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A written panel or benchmark stack, date as a date and numbers as doubles; columns prune the scan."""
    df = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.csv(path, header=True)
    texts = ("ticker", "exchange", "country", "region", "benchmark")
    kinds = {"date": "date"} | dict.fromkeys(texts, "string")
    return df.select(*[F.col(f"`{c}`").cast(kinds.get(c, "double")).alias(c) for c in columns or df.columns])


def write_table(df: DataFrame, path: str, by_year: bool = False) -> None:
    """Overwrites path with CSV (if it ends so) or Parquet, for Parquet optionally in a folder for each year; then years that df
    doesn't have stay as they are."""
    if PurePosixPath(path).suffix == ".csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif by_year:
        df.withColumn("year", F.year("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int = 64) -> None:
    """Saves df as a table of the catalogue, in a folder for each year and in buckets by ticker, sorted by date: windows,
    detectors and backtests, which all go by ticker, then read it without an exchange. Rows are dealt as the buckets are,
    so that a year has one file a bucket. Choose as many buckets as give files of some 100 MB in a year."""
    dealt = df.withColumn("year", F.year("date")).repartition(buckets, "ticker")
    dealt.write.mode("overwrite").partitionBy("year").bucketBy(buckets, "ticker").sortBy("ticker", "date").format("parquet").saveAsTable(table)


def rewrite_years(df: DataFrame, table: str) -> None:
    """Replaces the years that df has in a table of write_bucketed(); other years stay."""
    spark = df.sparkSession
    columns, buckets = spark.table(table).columns, next(int(r["data_type"]) for r in spark.sql(f"describe extended {table}").collect() if r["col_name"] == "Num Buckets")
    dealt = df.withColumn("year", F.year("date")).select(*[F.col(f"`{c}`") for c in columns]).repartition(buckets, "ticker")
    # as an option of the write this goes unheard, and the whole table would go
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop("year")

"""Bar sources: the seam, Parquet tables, REST responses and text files of scored pairs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import Protocol
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.schemas import REST_BARS, struct
from saltmarsh.sources.scratch import fresh


class BarSource(Protocol):
    """Anything that gives bars and a market series; nothing in them is dated after ``end``."""

    def bars(self, permnos: DataFrame, start: date, end: date) -> DataFrame: ...

    def market(self, start: date, end: date) -> DataFrame: ...


class TableBars:
    """Bars and market from two tables with the vendor's columns (prc may be signed, ret may be a code)."""

    def __init__(self, raw: DataFrame, index: DataFrame):
        self.raw, self.index = raw, index

    def bars(self, permnos: DataFrame, start: date, end: date) -> DataFrame:
        return clean_bars(self.raw.where(F.col("date").between(F.lit(start), F.lit(end))).join(permnos.select("permno"), "permno", "left_semi"))

    def market(self, start: date, end: date) -> DataFrame:
        return self.index.where(F.col("date").between(F.lit(start), F.lit(end))).select("date", F.col("vwretd").try_cast("double").alias("mkt")).where("mkt is not null")


class ParquetBars(TableBars):
    """The same from two Parquet tables."""

    def __init__(self, spark: SparkSession, bars_path: str, market_path: str):
        super().__init__(spark.read.parquet(bars_path), spark.read.parquet(market_path))


def clean_bars(raw: DataFrame) -> DataFrame:
    """Vendor bars to bars: prices without sign, codes and returns of -1 or less as null."""
    number = lambda c: F.col(c).try_cast("double")
    ret = number("ret")
    return raw.select(
        F.col("permno").cast("long").alias("permno"), F.col("date").cast("date").alias("date"), *(F.abs(number(c)).alias(c) for c in ("open", "high", "low")), F.abs(number("prc")).alias("close"),
        number("volume").alias("volume"), F.when(ret > -1, ret).alias("ret"), number("shrout").alias("shrout"),
    )


def returns(bars: DataFrame) -> DataFrame:
    """Adds ret, close over the previous close less one; null for the first bar and after a close that is not positive."""
    prev = F.lag("close").over(W.partitionBy("permno").orderBy("date"))
    return bars.withColumn("ret", F.when(prev > 0, F.try_divide(F.col("close"), prev) - 1))


def read_rest_bars(spark: SparkSession, path: str) -> DataFrame:
    """Responses of a bar service, one JSON object for each ticker; objects that cannot be read are left out."""
    return spark.read.schema(struct(REST_BARS)).option("mode", "DROPMALFORMED").json(path)


def rest_bars(responses: DataFrame, tickers: DataFrame) -> DataFrame:
    """Bars of the responses whose ticker has an id; prices of zero are null."""
    rows = responses.join(tickers, "ticker").select(F.col("permno").cast("long").alias("permno"), F.explode("results").alias("r"))
    price = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(0.0))
    flat = rows.select("permno", F.to_date(F.timestamp_millis("r.t")).alias("date"), price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("r.v").alias("volume"))
    return returns(flat).withColumn("shrout", F.lit(None).cast("double"))


def proxy_market(bars: DataFrame, permno: int) -> DataFrame:
    """The market series that one id's returns stand in for."""
    return bars.where((F.col("permno") == permno) & F.col("ret").isNotNull()).select("date", F.col("ret").alias("mkt"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A text file of pairs parted by white space, with a header in any case; all columns are text.

    The header is the file's first line, so the names come from one small read; lines with another
    number of fields are left out, and ``bad_lines`` counts them.
    """
    lines, names = _fields(spark, path)
    rows = lines.where(F.size("f") == len(names))
    table = rows.select(*(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)))
    return table.withColumnRenamed("vscore", "score") if "vscore" in names else table


def _fields(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The fields of all lines but blank ones and headers, and the header's names."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.get("f", F.lit(0)) != "")
    names = [x.lower() for x in lines.first()["f"]]
    return lines.where(F.lower(F.get("f", F.lit(0))) != names[0]), names


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """n_fields and n_lines of the lines that ``read_pairs`` leaves out."""
    lines, names = _fields(spark, path)
    return lines.where(F.size("f") != len(names)).groupBy(F.size("f").alias("n_fields")).agg(F.count("*").alias("n_lines"))


def skipped_tickers(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """ticker and reason of the asked tickers (ticker, permno) that give no bars: unmapped, no response, or an empty one."""
    got = responses.groupBy("ticker").agg(F.max(F.coalesce(F.size("results"), F.lit(0))).alias("n"))
    reason = F.when(F.col("permno").isNull(), "unmapped").when(F.col("n").isNull(), "no response").when(F.col("n") <= 0, "empty")
    return asked.join(got, "ticker", "left").select("ticker", reason.alias("reason")).where("reason is not null")


def store_bars(bars: DataFrame, name: str | None = None, buckets: int = 64) -> DataFrame:
    """Write bars to a table bucketed and sorted by id, and read it: windows and sums by id then need no exchange.

    The table is in the session's catalogue, named ``name`` or a new name, and its files are in the shared folder. A bucket holds many ids and all bars of
    each, so choose ``buckets`` by the size of the table.
    """
    spark, table = bars.sparkSession, name or f"bars_{uuid4().hex}"
    bars.repartition(buckets, "permno").write.mode("overwrite").bucketBy(buckets, "permno").sortBy("permno", "date").option("path", fresh(spark, table)).saveAsTable(table)
    return spark.table(table)


class YearlyTables:
    """One table a year, each with what columns its year had, read as one.

    ``path`` has {year} in it. Only the years of the span that is asked for are opened, all of them, those in the middle
    included; columns of ``schema`` that a year does not have are null, others are not read. Years without a table are left out.
    """

    def __init__(self, spark: SparkSession, path: str, years: Sequence[int], schema: str, day: str = "date"):
        self.spark, self.path, self.years, self.schema, self.day = spark, path, sorted(years), struct(schema), day

    def read(self, start: date, end: date) -> DataFrame:
        paths = [self.path.format(year=y) for y in self.years if start.year <= y <= end.year]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col(self.day).between(F.lit(start), F.lit(end)))

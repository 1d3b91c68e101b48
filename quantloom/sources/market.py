"""Sources and sinks of market data: schemas, scans, the symbol catalogue, converters, appends.

Files lie as root/category/SYMBOL.parquet.  A symbol is looked up in the categories in
CATEGORIES' order, and the first that has it wins.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ("etf", "stocks", "futures", "indices")

BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, adjclose double, volume bigint"
QUOTE_SCHEMA = (
    "date date, strike double, expiration date, option_type string, last double, bid double, ask double, bid_iv double, ask_iv double, "
    "open_interest bigint, volume bigint, delta double, gamma double, vega double, theta double, rho double"
)
#: The time of day that a quote with only a date stands for.
QUOTE_TIME = "15:59"


def safe_symbol(name: str) -> str:
    """An upper-case symbol that can be a file name; raises ValueError for anything else."""
    name = name.strip().upper()
    if not re.fullmatch(r"[A-Z0-9._^=-]+", name) or ".." in name:
        raise ValueError(f"not a symbol: {name!r}")
    return name


def with_symbol(df: DataFrame) -> DataFrame:
    """Adds symbol, from the file that each row comes from."""
    return df.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet", 1))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """category, symbol and path of every data file, by the file system's own listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath().toString()) for s in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "*/*.parquet")) or [])]
    rows = [(p.split("/")[-2], p.split("/")[-1].removesuffix(".parquet"), p) for p in found]
    return spark.createDataFrame(rows, "category string, symbol string, path string")


def search(catalog_: DataFrame, text: str | None = None) -> DataFrame:
    """Files whose symbol contains `text`; without it, the number of symbols by category."""
    if text is None:
        return catalog_.groupBy("category").agg(F.count("*").alias("n"))
    return catalog_.where(F.upper("symbol").contains(text.strip().upper())).orderBy("category", "symbol")


def resolve(catalog_: DataFrame) -> DataFrame:
    """One path a symbol: of the first of CATEGORIES that has it."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("rank", "path"))
    return catalog_.withColumn("rank", rank).where("rank > 0").withColumn("n", first).where("n = 1").select("symbol", "category", "path")


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a file or folder, whichever of datetime and date it has, in the common schema."""
    raw = with_symbol(spark.read.parquet(path))
    time = "datetime" if "datetime" in raw.columns else "date"
    adj = F.col("adjclose") if "adjclose" in raw.columns else F.col("close")
    return raw.select(
        "symbol", F.col(time).cast("timestamp_ntz").alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], adj.cast("double").alias("adjclose"), F.col("volume").cast("bigint").alias("volume")
    )


def quote_time(quotes: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Quotes with ts instead of date (the date at QUOTE_TIME), from the day `start` to the day `end`.

    The range is tested on the date itself, so that it reaches the scan.  Option types are
    reduced to c and p, if there is such a column.
    """
    if start:
        quotes = quotes.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        quotes = quotes.where(F.col("date") <= F.lit(end).cast("date"))
    hours, minutes = (int(x) for x in QUOTE_TIME.split(":"))
    out = quotes.withColumn("ts", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours), mins=F.lit(minutes))).drop("date")
    return out.withColumn("option_type", F.lower(F.substring("option_type", 1, 1))) if "option_type" in out.columns else out


def bar_lines(lines: DataFrame) -> DataFrame:
    """Bars from text lines (symbol, value): time, open, high, low, close and perhaps volume, separated by commas.

    Lines with fewer fields or without a readable time are left out; a price that cannot be
    read is NaN, a missing volume 0.
    """
    f = F.split("value", ",")
    price = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("double"), F.lit(float("nan")))
    ts = F.coalesce(F.try_to_timestamp(F.get(f, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.get(f, F.lit(0)), F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")
    out = lines.where(F.size(f) >= 5).select(
        "symbol", ts.alias("ts"), price(1).alias("open"), price(2).alias("high"), price(3).alias("low"), price(4).alias("close"), price(4).alias("adjclose"), F.coalesce(F.get(f, F.lit(5)).try_cast("double"), F.lit(0.0)).cast("bigint").alias("volume")
    )
    return out.where("ts is not null")


def quote_lines(lines: DataFrame) -> DataFrame:
    """Quotes from text lines (symbol, value) of at least 16 fields in QUOTE_SCHEMA's order; shorter lines are left out."""
    f = F.split("value", ",")
    fields = [x.strip().split(" ") for x in QUOTE_SCHEMA.split(",")]
    columns = [F.get(f, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
    return lines.where(F.size(f) >= 16).select("symbol", *columns).where("date is not null and expiration is not null")


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """symbol (the member's stem) and value (a line) of every text file in the ZIP files at `path`.

    One task reads one archive, a member's lines at a time.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0].split("_")[0].upper()
                        with archive.open(name) as member:
                            for chunk in iter(lambda m=member: m.readlines(1 << 22), []):
                                yield pd.DataFrame({"symbol": stem, "value": [x.decode("utf-8", "replace").rstrip("\r\n") for x in chunk]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "symbol string, value string")


def write_sorted(df: DataFrame, path: str, sort: list[str], mode: str = "append") -> None:
    """Snappy Parquet in a folder a symbol, sorted within files so that footers prune by time."""
    df.repartition("symbol").sortWithinPartitions("symbol", *sort).write.mode(mode).partitionBy("symbol").option("compression", "snappy").parquet(path)


def newer(incoming: DataFrame, stored: DataFrame, key: str = "ts") -> DataFrame:
    """The incoming rows that are later than the last stored one of their symbol: what an append adds."""
    last = stored.groupBy("symbol").agg(F.max(key).alias("__last"))
    return incoming.join(last, "symbol", "left").where(F.col("__last").isNull() | (F.col(key) > F.col("__last"))).drop("__last")


def corporate_actions(lines: DataFrame, value: str) -> DataFrame:
    """symbol, date and `value` from lines (value: symbol,date,number); bad dates and numbers at or below 0 are left out."""
    f = F.split("value", ",")
    rows = lines.where((F.size(f) >= 3) & (F.length(F.trim(F.get(f, F.lit(1)))) == 10)).select(
        F.upper(F.trim(F.get(f, F.lit(0)))).alias("symbol"), F.trim(F.get(f, F.lit(1))).try_cast("date").alias("date"), F.trim(F.get(f, F.lit(2))).try_cast("double").alias(value)
    )
    return rows.where(F.col("date").isNotNull() & (F.col(value) > 0)).dropDuplicates(["symbol", "date"])

"""Series in and results out: regular calendars, odd time stamps, Parquet and CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decimal_year(year: Column, unit: str = "hours") -> Column:
    """Timestamp of a decimal year, rounded to whole hours or weeks of that year (leap years are longer)."""
    whole = F.floor(year).cast("int")
    hours = F.when((whole % 4 == 0) & ((whole % 100 != 0) | (whole % 400 == 0)), 8784).otherwise(8760)
    start = F.make_timestamp_ntz(whole, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    n = (year - whole) * hours
    if unit == "weeks":
        return start + F.make_interval(weeks=F.round(n / 168).cast("int"))
    return start + F.make_interval(hours=F.round(n).cast("int"))


def month_day_time(text: Column) -> Column:
    return F.to_timestamp(text, "M/d/yy H:mm")


def datenum(number: Column) -> Column:
    """Timestamp of a day number that counts from year 0, in microseconds."""
    return F.timestamp_micros(F.round((number - 719529) * 86_400_000_000).cast("long"))


def minute_rounded(ts: Column) -> Column:
    """A second before the full minute counts as the minute."""
    return F.date_trunc("minute", ts + F.expr("INTERVAL 1 SECOND"))


def regular(df: DataFrame, time: str, step: str, first: object = None, last: object = None) -> DataFrame:
    """df on a calendar of equal steps (as '7 HOURS') from its first to its last time; missing slots are null."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    spine = ends.select(F.explode(F.expr(f"sequence(a, b, INTERVAL {step})")).alias(time))
    return spine.join(df, time, "left")


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Parquet, or CSV with a header; sheets of a workbook are exported to either first."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, **options) if path.endswith(".csv") else reader.parquet(path)


def results_of(results: DataFrame, source: str | None = None, parents: str | None = None, start: int = 1) -> DataFrame:
    """Rows of a long table of results (source, parents, tau, ...) from lag `start` on."""
    out = results.filter(F.col("tau") >= start)
    for column, value in (("source", source), ("parents", parents)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("target",)) -> None:
    results.write.mode("overwrite").partitionBy(*by).parquet(path)


#: Event types that may become columns.
MOST_TYPES = 100


def hourly_events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """t (hours since 1970) and x, or x0..x4 of the event types in order: mean event values by hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("long").alias("t")
    if not by_type:
        return events.groupBy(t).agg(F.avg("value").alias("x"))
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(MOST_TYPES + 1).collect()]
    if len(kinds) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types: they are columns here; select some first")
    aggs = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"x{i}") for i, k in enumerate(kinds)]
    return events.groupBy(t).agg(*aggs)


def daily_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (days since 1970), x0..x2: daily quantity, mean price and mean discount of lineitem."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    t = F.unix_date(F.to_date("l_shipdate")).cast("long").alias("t")
    return items.groupBy(t).agg(F.sum("l_quantity").alias("x0"), F.avg("l_extendedprice").alias("x1"), F.avg("l_discount").alias("x2"))


def indexed(df: DataFrame, time: str = "t") -> DataFrame:
    """Consecutive numbers 0.. in place of times; for series of up to some million rows, as it sorts in one task."""
    return df.withColumn(time, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1).cast("long"))

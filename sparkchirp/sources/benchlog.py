"""Timing logs: lines ``label : seconds`` in text files, one file a test, summed up by test and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels of timing lines, in the order of the summary's columns.
LABELS = (
    "Initialization time",
    "Preprocessing time",
    "Dedispersion time",
    "Postprocessing time",
    "Input memcpy time",
    "Output memcpy time",
    "Runtime",
    "GPU execution time",
    "Total time",
)
NUMBER = r"[+-]?[0-9]+\.[0-9]+"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(test, line): the test is the file name up to its first dot."""
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1).alias("test"), F.col("value").alias("line"))


def timings(lines: DataFrame, labels=LABELS) -> DataFrame:
    """(test, timing, seconds) of the lines with a label, blanks and a colon; seconds is null unless the line has just one number."""
    label: Column = F.coalesce(*[F.when(F.col("line").rlike(rf"{x} *: "), F.lit(x)) for x in labels])
    numbers = F.regexp_extract_all(F.col("line"), F.lit(f"({NUMBER})"), 1)
    seconds = F.when(F.size(numbers) == 1, F.element_at(numbers, 1).cast("double"))
    return lines.select("test", label.alias("timing"), seconds.alias("seconds")).where("timing is not null")


def summary(times: DataFrame) -> DataFrame:
    """(test, timing, n, lo, hi, mean, std): standard deviation of the population; null where a value of the test is missing."""
    whole = F.count("seconds") == F.count(F.lit(1))
    stats = {"lo": F.min("seconds"), "hi": F.max("seconds"), "mean": F.avg("seconds"), "std": F.stddev_pop("seconds")}
    return times.groupBy("test", "timing").agg(F.count(F.lit(1)).alias("n"), *[F.when(whole, c).alias(n) for n, c in stats.items()])


def mean_table(times: DataFrame, labels=LABELS) -> DataFrame:
    """One row a test: its name, a key to sort by, and the mean of every label, in their order."""
    means = summary(times).groupBy("test").pivot("timing", list(labels)).agg(F.first("mean"))
    key = F.regexp_replace(F.regexp_replace("test", "_", ":"), "nchan|nsamp|ndm", "")
    return means.select("test", key.alias("sort_by"), *[F.col(f"`{x}`") for x in labels])


def write_mean_table(times: DataFrame, path: str) -> None:
    mean_table(times).write.option("sep", ":").option("header", True).csv(path)


def events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made of events: the value as the run time of the event's type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.col("event_type").alias("test"), F.concat(F.lit("Runtime             : "), F.format_string("%.2f", F.round("value", 2)), F.lit(" sec.")).alias("line"))
    return summary(timings(lines)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


EVENTS_SQL = """
    WITH lines AS (SELECT event_type AS test, 'Runtime             : ' || printf('%.2f', round(value, 2)) || ' sec.' AS line FROM events),
    times AS (SELECT test, regexp_extract(line, '^([A-Za-z]+)', 1) AS timing, regexp_extract(line, '([+-]?[0-9]+\\.[0-9]+)', 1)::DOUBLE AS seconds FROM lines)
    SELECT test, timing, count(*) AS n, min(seconds) AS lo, max(seconds) AS hi, round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS std
    FROM times GROUP BY test, timing
"""

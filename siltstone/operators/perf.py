"""Statistics of performance logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The counters of a log's last section, by column, pattern and type.
COUNTERS = (
    ("cycles", r"(\d+)\s+cycles:u", "bigint"),
    ("instructions", r"(\d+)\s+instructions:u", "bigint"),
    ("cache_references", r"(\d+)\s+cache-references:u", "bigint"),
    ("cache_misses", r"(\d+)\s+cache-misses:u", "bigint"),
    ("seconds_time_elapsed", r"(\d+\.\d+)\s+seconds time elapsed", "double"),
    ("seconds_user", r"(\d+\.\d+)\s+seconds user", "double"),
    ("seconds_sys", r"(\d+\.\d+)\s+seconds sys", "double"),
)
SECTION = "Performance counter stats"


def extract(logs: DataFrame) -> DataFrame:
    """(run, counters) of whole logs (run, content), null where absent; logs without the section are left out."""
    section = F.substring_index("content", SECTION, -1)
    found = logs.where(F.contains("content", F.lit(SECTION)))
    return found.select("run", *(F.regexp_extract(section, p, 1).try_cast(kind).alias(name) for name, p, kind in COUNTERS))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, content) of every log file, whole; ``run`` is the last number in its name."""
    files = spark.read.text(path, wholetext=True).select("_metadata.file_name", F.col("value").alias("content"))
    return files.select(F.regexp_extract("file_name", r"([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("run"), "content")


METRICS = "run bigint, " + ", ".join(f"{name} {kind}" for name, _, kind in COUNTERS)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(run, counters) of one benchmark as CSV with a header, in a folder named ``logs_<op>_<variant>_metrics.csv``."""
    metrics.select("run", *(name for name, _, _ in COUNTERS)).write.mode("overwrite").csv(path, header=True)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(op, variant, run, counters) of metrics files, or folders of them, labelled by their names."""
    rows = spark.read.schema(METRICS).csv(path, header=True)
    op, variant = labels(F.regexp_replace("_metadata.file_path", r"\.csv/[^/]+$", ".csv"))
    return rows.select(op.alias("op"), variant.alias("variant"), *rows.columns)


def labels(name):
    """(op, variant) of a metrics file ``logs_<op>_<variant>_metrics.csv``; the variant may hold underscores."""
    core = F.regexp_extract(name, r"logs_([^/]+)_metrics\.csv$", 1)
    parts = F.split(core, "_", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def mean_std(runs: DataFrame, metric: str, part: str, whole: str) -> DataFrame:
    """(op, variant, n, mean, std, ratio): sample statistics, and the mean of each run's percentage."""
    return runs.groupBy("op", "variant").agg(
        F.count("*").alias("n"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.avg(F.try_divide(F.col(part), F.col(whole)) * 100).alias("ratio"),
    )


def summary(means: DataFrame) -> DataFrame:
    """(op, mean, spread, std) of the variants' means."""
    return means.groupBy("op").agg(F.avg("mean").alias("mean"), (F.max("mean") - F.min("mean")).alias("spread"), F.stddev_samp("mean").alias("std"))

"""The report store: one JSON envelope per company, written and scanned by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "ticker string, updated_at string, analysis_version string, runtime_overrides map<string,double>, result struct<quarters:array<string>,overall_score:double>"


def write_reports(reports: DataFrame, path: str) -> None:
    """Overwrites the folders of the tickers in ``reports`` (columns of ENVELOPE) and no others."""
    reports.withColumn("ticker_key", F.upper("ticker")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker_key").json(path)


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """All envelopes; malformed files are left out."""
    schema = ENVELOPE + ", broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("multiLine", True).json(path)
    return rows.where("broken IS NULL AND ticker IS NOT NULL").drop("broken")


def delete_report(spark: SparkSession, path: str, ticker: str) -> bool:
    """Removes one company's envelope; whether there was one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ticker_key={ticker.strip().upper()}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def point_read(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """One company's envelope; only its partition is read."""
    return scan_reports(spark, path).where(F.col("ticker_key") == ticker.strip().upper())


def summaries(reports: DataFrame) -> DataFrame:
    """ticker, updated_at, quarters (distinct, sorted), overall_score, newest first."""
    return reports.select(
        "ticker", "updated_at", F.sort_array(F.array_distinct("result.quarters")).alias("quarters"), F.col("result.overall_score").alias("overall_score")
    ).orderBy(F.col("updated_at").desc(), "ticker")

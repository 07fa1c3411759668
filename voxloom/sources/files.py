"""Files of call records, exports and media folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUDIO = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "wma")
WRITERS = {"parquet": lambda df, path: df.write.parquet(path), "csv": lambda df, path: df.write.option("header", True).csv(path), "jsonl": lambda df, path: df.write.json(path)}


def read_records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of a folder of JSON files, one document each, and the files that aren't valid (file, content)."""
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = texts.withColumn("x", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}))
    return rows.where("x._corrupt is null").select("x.*").drop("_corrupt"), rows.where("x._corrupt is not null").select("file", F.col("value").alias("content"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder: path, size, language and call type by the names of their folders. The files' contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    low = F.lower("path")
    language = F.regexp_extract(low, r"/(en|hi|ta|te|bn|mr)/", 1)
    kind = F.regexp_extract(low, r"/(collections|kyc|consent|onboarding|complaint)/", 1)
    return rows.where(low.rlike(r"\.(?:" + "|".join(AUDIO) + ")$")).select("path", "length", F.when(language == "", "en").otherwise(language).alias("language"), F.when(kind == "", "general").otherwise(kind).alias("call_type"))


def export_all(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Writes every table that has rows in its format (parquet, csv, jsonl); returns the manifest name, format, path, n. Counts are observed while writing."""
    done = []
    for name, (frame, kind) in tables.items():
        if frame.isEmpty():
            continue
        seen = Observation()
        path = f"{folder}/{name}"
        WRITERS[kind](frame.observe(seen, F.count(F.lit(1)).alias("n")), path)
        done.append((name, kind, path, seen.get["n"]))
    return spark.createDataFrame(done, "name string, format string, path string, n long")


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Adds human corrections beside the calls."""
    corrections.write.mode("append").parquet(path)

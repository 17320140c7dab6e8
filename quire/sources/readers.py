"""Readers: files and catalog tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.runtime import scratch_path


def read_jsonl(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    """JSON lines, plain or gzipped. Give ``schema`` to skip the inference pass over the data."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_json_docs(spark: SparkSession, paths, schema: StructType | None = None) -> DataFrame:
    """One JSON object per file, with its ``source_file``."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(paths).select("*", F.col("_metadata.file_path").alias("source_file"))


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_strings(spark: SparkSession, path) -> DataFrame:
    """CSV with a header row, every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def json_infer_parse(df: DataFrame, col: str, out: str) -> DataFrame:
    """Infer the schema of a JSON string column and parse it into ``out``.

    The schema comes from every row (a distributed JSON scan), so no field that is rare in the data is lost.
    """
    spark = df.sparkSession
    strings = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"))
    path = scratch_path(spark, "json-infer")
    strings.write.text(path)
    return df.withColumn(out, F.from_json(col, spark.read.json(path).schema))


def key_from_filename(df: DataFrame, col: str) -> DataFrame:
    """Adds ``id`` and ``manifest_id``: the base name cut at its first ``_``, extension dropped."""
    base = F.regexp_extract(F.col(col), r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return df.withColumn("id", F.regexp_extract(stem, r"^([^_]*)", 1)).withColumn(
        "manifest_id", F.regexp_extract(stem, r"^[^_]*_(.*)$", 1))


def export_visible_records(df: DataFrame, type_col: str, drop_types: list[str],
                           id_candidates: list[str | Column], exported_at: str | Column | None = None) -> DataFrame:
    """Rows whose type is not hidden, with ``canonical_id`` from the first id present."""
    when = F.current_timestamp() if exported_at is None else F.lit(exported_at)
    ids = [F.col(c) if isinstance(c, str) else c for c in id_candidates]
    visible = F.col(type_col).isNull() | ~F.col(type_col).isin(drop_types)
    return df.where(visible).withColumn("canonical_id", F.coalesce(*ids)).withColumn("exported_at", when)

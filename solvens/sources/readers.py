"""Readers with explicit schemas, and sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvens.schemas import CLASS_NAMES, ID_COLUMNS, RATIO_COLUMNS, STATEMENT_SCHEMA, TARGET_COLUMN, raw_filing_schema


def normalize_header(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def _read_or_empty(read, spark: SparkSession, schema: T.StructType, optional: bool) -> DataFrame:
    """Only a missing path counts as absent; every other error is the caller's to see."""
    try:
        return read()
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_filings(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv", optional: bool = False) -> DataFrame:
    """Raw filings as text columns, ``fmt`` csv (with header) or parquet."""
    schema = schema or raw_filing_schema()

    def read():
        if fmt == "csv":
            # Names are taken from one header, after trimming; a file whose header differs fails loudly.
            header = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
            return normalize_header(header)
        return normalize_header(spark.read.format(fmt).load(path))

    return _read_or_empty(read, spark, schema, optional)


def read_statements(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """Landed statements in long form."""
    return _read_or_empty(
        lambda: spark.read.schema(STATEMENT_SCHEMA).parquet(path), spark, STATEMENT_SCHEMA, optional
    )


def read_feature_documents(df: DataFrame, column: str, features: list[str], keep: list[str] = ()) -> DataFrame:
    """JSON text to one numeric column per feature; absent keys and bad numbers are NULL."""
    from solvens.functions.numeric import to_double

    doc = df.withColumn("_doc", F.from_json(F.col(column), T.MapType(T.StringType(), T.StringType())))
    return doc.select(*keep, *[to_double(F.try_element_at("_doc", F.lit(f))).alias(f) for f in features])


def read_feature_files(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """One JSON document per file."""
    return read_feature_documents(spark.read.text(path, wholetext=True), "value", features)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Overwrite ``path``; csv keeps a header and no row index."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # Outer blanks are data here; an empty field reads back as NULL.
        writer = (
            writer.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def label_mapping(features: list[str] = RATIO_COLUMNS) -> dict:
    """Class codes and column roles, as stored beside a trained model."""
    return {
        "string_to_numeric": {n: i for i, n in enumerate(CLASS_NAMES)},
        "numeric_to_string": {str(i): n for i, n in enumerate(CLASS_NAMES)},
        "feature_columns": list(features),
        "id_columns": list(ID_COLUMNS),
        "target_column": TARGET_COLUMN,
    }


LABEL_MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("string_to_numeric", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("numeric_to_string", T.MapType(T.StringType(), T.StringType())),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("id_columns", T.ArrayType(T.StringType())),
        T.StructField("target_column", T.StringType()),
    ]
)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    row = spark.createDataFrame([(json.dumps(document),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)

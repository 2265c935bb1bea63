"""Readers and sinks."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from solvens.schemas import RATIO_COLUMNS, raw_filing_schema
from solvens.session import scratch_path
from solvens.sources import readers, tables


def test_missing_source(spark):
    path = scratch_path(spark, "absent")
    assert readers.read_filings(spark, path, optional=True).schema == raw_filing_schema()
    assert readers.read_statements(spark, path, optional=True).count() == 0
    with pytest.raises(AnalysisException):
        readers.read_filings(spark, path)


def test_csv_with_blank_headers(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("A", "2020", "Healthy", '"1"')], "Folder_name string, Feature_name string, Label string, x1 string")
    readers.write_table(df.toDF(*[f" {c}" for c in df.columns]), path, "csv")
    assert [tuple(r) for r in readers.read_filings(spark, path).collect()] == [("A", "2020", "Healthy", '"1"')]


def test_label_mapping_document(spark):
    path = scratch_path(spark, "json")
    readers.write_json_document(spark, readers.label_mapping(), path)
    row = readers.read_json_document(spark, path, readers.LABEL_MAPPING_SCHEMA).first()
    assert row.numeric_to_string["2"] == "Probably Bankrupt" and row.feature_columns == RATIO_COLUMNS
    assert row.string_to_numeric["Healthy"] == 3 and row.target_column == "Target"


def test_feature_files(spark):
    path = scratch_path(spark, "docs")
    readers.write_json_document(spark, {"x1": 0.5, "x2": "abc", "x3": "2"}, path)
    assert tuple(readers.read_feature_files(spark, path, ["x1", "x2", "x3", "x4"]).first()) == (0.5, None, 2.0, None)


def test_customer_names_identify_customers(spark, data_dir):
    c = tables.table(spark, data_dir, "customer")
    assert c.select("c_name").distinct().count() == c.count()


def test_partitioned_sink(spark):
    path = scratch_path(spark, "parts")
    readers.write_table(spark.range(10).withColumn("k", F.col("id") % 2), path, partition_by=["k"])
    assert spark.read.parquet(path).filter("k = 1").count() == 5


def test_differing_headers_fail(spark):
    path = scratch_path(spark, "csv")
    a = spark.createDataFrame([("A", "2020", "1")], "Folder_name string, Label string, x1 string")
    a.coalesce(1).write.option("header", True).csv(path)
    a.select("Label", "Folder_name", "x1").coalesce(1).write.mode("append").option("header", True).csv(path)
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_filings(spark, path).collect()

"""Streaming runs over landed files; each must end with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvens.operators import statements as st
from solvens.plans.base import with_tables
from solvens.plans.statements import ORACLES as STATEMENT_ORACLES
from solvens.session import scratch_path
from solvens.sources import tables
from solvens.streaming import filings as stream


def _land(df, spark, name: str, files: int):
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return path


def _land_by_time(df, spark, name: str, period, files: int):
    """Files in the order of ``period`` (small whole numbers); each is written after the ones before it."""
    path = scratch_path(spark, name)
    rows = df.withColumn("_p", period)
    for p in sorted(r[0] for r in rows.select("_p").distinct().collect()):
        rows.filter(F.col("_p") == p).drop("_p").repartition(files).write.mode("append").parquet(path)
    return path


def stream_latest_filing(spark, d):
    rows = tables.labelled(spark, d).select("company", "year", "sales", "target")
    landed = _land(rows, spark, "landed", 3)
    sink = stream.UpsertTable(spark, scratch_path(spark, "latest"), "company", rows.schema, order="year")
    source = stream.file_stream(spark, landed, rows.schema, files_per_batch=1)
    stream.start_upserts(stream.latest_updates(source, "company", "year"), sink, scratch_path(spark, "offsets")).awaitTermination()
    return sink.read()


def stream_deduplicate(spark, d):
    """Filings arrive by year, copies of a third of them ten days later; state is kept for 30 days."""
    day = F.pmod(F.xxhash64("company", "year"), F.lit(360)).cast("int")
    filed = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), day).cast("timestamp")
    rows = tables.labelled(spark, d).select("company", "year", "target", filed.alias("filed_at"))
    again = rows.filter("year % 3 = 0").withColumn("filed_at", F.col("filed_at") + F.expr("interval 10 days"))
    rows = rows.unionByName(again).unionByName(again)
    landed = _land_by_time(rows, spark, "copies", F.year("filed_at"), 1)
    out = scratch_path(spark, "unique")
    source = stream.file_stream(spark, landed, rows.schema, files_per_batch=1)
    unique = stream.suppress_duplicates(source, ["company", "year"], "filed_at")
    stream.start_to_folder(unique, out, scratch_path(spark, "offsets")).awaitTermination()
    found = spark.read.option("basePath", out).parquet(out)
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("company", "year").alias("filings"))


def stream_ratios(spark, d):
    rows = tables.statements_long(spark, d)
    landed = _land(rows, spark, "statements", 3)

    def ratios(metrics):
        full = st.ratio_block(metrics)
        return full.select("ticker", *[c for c in full.columns if c not in metrics.columns])

    shape = ratios(st.statement_metrics(rows)).schema
    sink = stream.UpsertTable(spark, scratch_path(spark, "ratios"), "ticker", shape)
    source = stream.file_stream(spark, landed, rows.schema, files_per_batch=1)
    stream.score_new_statements(source, sink, scratch_path(spark, "offsets"), ratios).awaitTermination()
    return sink.read()


QUERIES = {
    "stream_latest_filing": stream_latest_filing,
    "stream_deduplicate": stream_deduplicate,
    "stream_ratios": stream_ratios,
}
ORACLES = {
    "stream_latest_filing": with_tables(
        "select company, year, sales, target from labelled qualify row_number() over (partition by company order by year desc)=1",
        "labelled",
    ),
    "stream_deduplicate": with_tables(
        "select target, count(*) as rows, count(*) as filings from labelled group by target", "labelled"
    ),
    "stream_ratios": STATEMENT_ORACLES["ratio_block"],
}

"""Streams against the batch result of the same rows, restarts, and what stays on disk and in state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from solvens.functions.ordering import BUCKET, quantile_buckets
from solvens.operators import statements as st
from solvens.session import scratch_path
from solvens.streaming import filings as stream

SCHEMA = "key string, at int, value double"


def _sink(spark, **kw):
    from pyspark.sql.types import _parse_datatype_string

    return stream.UpsertTable(spark, scratch_path(spark, "sink"), "key", _parse_datatype_string(SCHEMA), **kw)


def _rows(sink):
    return {r.key: (r.at, r.value) for r in sink.read().collect()}


def test_upserts_keep_the_newest_row_and_two_generations(spark):
    sink = _sink(spark, order="at", buckets=3)
    assert sink.read().count() == 0 and sink.batch() == -1
    want = {}
    for b in range(5):
        rows = [(f"k{i}", b if i % 2 else -b, float(100 * b + i)) for i in range(b, b + 6)]
        rows.append((None, b, 0.5))
        sink.upsert(spark.createDataFrame(rows, SCHEMA), b)
        for k, at, v in rows:
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)
        assert _rows(sink) == want and sink.batch() == b
    assert len(glob.glob(f"{sink.path}/data/slot=*/bucket=*")) <= 6
    assert len(glob.glob(f"{sink.path}/manifest/*/part-*")) == 2


def test_a_batch_run_again_or_cut_off_changes_nothing(spark):
    sink = _sink(spark, buckets=2)
    sink.upsert(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], SCHEMA), 0)
    sink.upsert(spark.createDataFrame([("a", 9, 9.0)], SCHEMA), 0)
    assert _rows(sink) == {"a": (1, 1.0), "b": (1, 2.0)}
    # A batch whose data was written but whose manifest was not is not seen, and its repetition is.
    sink.upsert(spark.createDataFrame([("a", 2, 3.0)], SCHEMA), 1)
    newest = max(glob.glob(f"{sink.path}/manifest/*"), key=lambda p: next(r.batch for r in spark.read.schema(sink.MANIFEST).json(p).collect()))
    spark.createDataFrame([], sink.MANIFEST).write.mode("overwrite").json(newest)
    assert _rows(sink) == {"a": (1, 1.0), "b": (1, 2.0)}
    sink.upsert(spark.createDataFrame([("a", 2, 3.0)], SCHEMA), 1)
    assert _rows(sink) == {"a": (2, 3.0), "b": (1, 2.0)}
    sink.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert _rows(sink) == {"a": (2, 3.0), "b": (1, 2.0)}


def _statements(spark, years, tickers=12):
    rows = []
    for t in range(tickers):
        for y in years:
            rows += [
                (f"t{t}", "income", "annual", "Total Revenue", y, 1e9 + t * 1e7 + y),
                (f"t{t}", "income", "annual", "Operating Income", y, 1e8 + y),
                (f"t{t}", "balance", "annual", "Total Debt", y, 5e8 - t * 1e7),
            ]
    # A ticker without a balance sheet is never scored.
    rows.append(("lone", "income", "annual", "Total Revenue", 2001, 1.0))
    return spark.createDataFrame(rows, "ticker string, statement string, freq string, line_item string, period int, value double")


def test_statements_keep_their_state_between_runs(spark):
    landed, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "offsets")
    parts = [_statements(spark, [2001]), _statements(spark, [2003], 6), _statements(spark, [2002])]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = st.ratio_block(st.statement_metrics(whole)).select("ticker", "latest_period", "sales", "operating_margin", "debt_to_equity")
    sink = stream.UpsertTable(spark, scratch_path(spark, "ratios"), "ticker", want.schema, buckets=4)
    shown = want.columns
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(landed)
        source = stream.file_stream(spark, landed, whole.schema, files_per_batch=1)
        query = stream.score_new_statements(source, sink, checkpoint, lambda m: st.ratio_block(m).select(*shown))
        query.awaitTermination()
    assert sorted(sink.read().collect()) == sorted(want.collect())
    assert want.count() == 12


def test_duplicates_leave_the_state_behind_the_watermark(spark):
    landed = scratch_path(spark, "landed")
    for month in range(1, 9):
        rows = spark.range(40).select(F.concat(F.lit(f"{month}-"), "id").alias("key"), F.make_timestamp(F.lit(2020), F.lit(month), F.lit(5), F.lit(0), F.lit(0), F.lit(0.0)).alias("at"))
        rows.unionByName(rows).coalesce(1).write.mode("append").parquet(landed)
    out = scratch_path(spark, "unique")
    source = stream.file_stream(spark, landed, rows.schema, files_per_batch=1)
    query = stream.start_to_folder(stream.suppress_duplicates(source, ["key"], "at"), out, scratch_path(spark, "offsets"))
    query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 320 and found.select("key").distinct().count() == 320
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) <= 3 * 40 and os.path.isdir(out)


@pytest.mark.parametrize("buckets", [2, 7, 64, 500])
def test_buckets_follow_the_order(spark, buckets):
    df = spark.range(5000).select((F.col("id") % 3).cast("int").alias("g"), (F.xxhash64("id") / 2**40).alias("v"))
    got = quantile_buckets(df, ["g"], "v", buckets)
    per = got.groupBy("g", BUCKET).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in per) == 5000
    for g in range(3):
        own = sorted((r[BUCKET], r.low, r.high, r.n) for r in per if r.g == g)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))
        assert max(r[3] for r in own) <= 2 * 5000 / 3 / buckets + 12 and len(own) <= buckets

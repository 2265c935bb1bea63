"""Structured Streaming over landed statements and filings.

Appending sinks write one folder per micro-batch and overwrite it when the batch is run
again; ``UpsertTable`` keeps the newest row per key and passes over a batch it has already
published.  So a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from solvens.operators.statements import apply_defaults, raw_metrics


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def suppress_duplicates(stream: DataFrame, keys: list[str], event_time: str, delay: str = "30 days") -> DataFrame:
    """First arrival of each key; state is kept for ``delay`` of event time, then dropped.

    A copy that comes later than that counts as new; rows more than ``delay`` behind the newest event time seen are late and left out.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def latest_updates(stream: DataFrame, key: str, order: str | Column) -> DataFrame:
    """Newest row per key as a running aggregate; the state holds one row per key."""
    rank = F.col(order) if isinstance(order, str) else order
    row = F.struct(*[F.col(c) for c in stream.columns])
    return stream.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


def _batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Run ``stream`` into ``path``; with ``available_now`` it stops after what has landed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(_batch_writer(path, transform))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_new_statements(stream: DataFrame, sink: "UpsertTable", checkpoint: str, score: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Score every ticker whose statements changed, from state kept per ticker.

    ``raw_metrics`` runs as a running aggregate: the state holds the newest value of each metric, one row per ticker, and each batch hands on
    the tickers that it changed.  No landed file is read twice, so a replay from the same offsets gives the same rows.
    ``score`` is a projection of accepted tickers with defaults applied; its result replaces the ticker's row in ``sink``.
    """
    known = raw_metrics(stream)

    def run(batch: DataFrame) -> DataFrame:
        return score(apply_defaults(batch.filter("accepted")).drop("accepted"))

    return start_upserts(known, sink, checkpoint, run, available_now)


@dataclass(frozen=True)
class UpsertTable:
    """The newest row per key, in hash buckets below ``path``; a batch rewrites only the buckets it touches.

    Each bucket has two slots and each batch writes the slot that isn't in use, so at most two generations of a bucket are on disk, however many
    batches have run.  The manifest names the slot in use per bucket and the last batch.  It has two slots as well: one small file, put in
    place by a rename, so a batch becomes visible whole or not at all; a batch that is run again after it was published is passed over.  A reader keeps
    a consistent version until two later batches have touched the bucket that it reads.

    Rows with a null key are one key.  ``order`` (a column of the rows) decides which row is newest; without it the later batch wins and within a batch rows
    must be unique by key.
    """

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    order: str | None = None
    buckets: int = 16

    MANIFEST = "batch long, slots array<int>"

    def _newest(self) -> tuple[int, list[int] | None, int]:
        """Last published batch, the slot per bucket and the manifest's own slot."""
        versions = []
        for slot in (0, 1):
            try:
                row = self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest/{slot}").first()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            if row:
                versions.append((row.batch, list(row.slots), slot))
        return max(versions, default=(-1, None, 1))

    def batch(self) -> int:
        """The last published batch; -1 before the first."""
        return self._newest()[0]

    def read(self) -> DataFrame:
        """One row per key, from the newest version."""
        _, slots, _ = self._newest()
        return self._slots(slots, range(self.buckets)) if slots else self.spark.createDataFrame([], self.schema)

    def _slots(self, slots: list[int], buckets) -> DataFrame:
        used = [f"{self.path}/data/slot={slots[b]}/bucket={b}" for b in buckets if slots[b] >= 0]
        return self.spark.read.schema(self.schema).parquet(*used) if used else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Rows replace those of equal key; buckets that ``rows`` doesn't touch stay as they are."""
        last, slots, own = self._newest()
        if batch_id <= last:
            return
        slots = slots or [-1] * self.buckets
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).persist()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())
        if touched:
            merged = self._slots(slots, touched).withColumn("_late", F.lit(0)).unionByName(rows.withColumn("_late", F.lit(1)))
            rank = F.struct(F.col(self.order), F.col("_late")) if self.order else F.col("_late")
            names = [f.name for f in self.schema]
            merged = merged.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*")
            free = {b: 1 if slots[b] == 0 else 0 for b in touched}
            slot = F.element_at(F.create_map(*[F.lit(v) for pair in free.items() for v in pair]), F.col("bucket"))
            merged = merged.withColumn("bucket", bucket).withColumn("slot", slot).repartition(len(touched), "bucket")
            writer = merged.write.partitionBy("slot", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.parquet(f"{self.path}/data")
            for b, s in free.items():
                slots[b] = s
        rows.unpersist()
        version = self.spark.createDataFrame([(batch_id, slots)], self.MANIFEST)
        version.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{1 - own}")


def start_upserts(stream: DataFrame, sink: UpsertTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Keep ``sink`` up to date with a running aggregate (update mode)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.upsert(transform(batch) if transform else batch, batch_id)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

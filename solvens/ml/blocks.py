"""Rows of a table as numpy blocks: passes over them cost what the numbers cost, not what Python rows cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4_096


def blocks(df: DataFrame, features: str, columns: dict[str, Column], size: int = BLOCK):
    """RDD of (features as a matrix, *columns as arrays), each of at most ``size`` rows; missing features are not-a-number.

    ``columns`` are numbers without nulls.  A partition's rows keep their order and places.
    """
    is_vector = df.schema[features].dataType.typeName() == "vectorudt"
    x = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    names = list(columns)

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield one(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield one(pa.Table.from_batches(held))

    def one(table):
        vectors = table.column("_x").combine_chunks()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(vectors.offsets.to_numpy())
        if vectors.null_count or (lengths != lengths[0]).any():
            raise ValueError("vectors differ in length")
        if any(table.column(c).null_count for c in names):
            raise ValueError(f"nulls in {names}")
        arrays = [table.column(c).to_numpy() for c in names]
        parts = [np.int64(len(vectors)).tobytes(), values.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]
        kinds = ",".join(a.dtype.str for a in arrays)
        return pa.RecordBatch.from_pydict({"kinds": [kinds], "parts": pa.array([parts], pa.list_(pa.binary()))})

    def unpack(row):
        n, values, *arrays = row["parts"]
        n = int(np.frombuffer(n, np.int64)[0])
        kinds = row["kinds"].split(",") if arrays else []
        return (np.frombuffer(values, np.float64).reshape(n, -1).copy(), *[np.frombuffer(a, k).copy() for a, k in zip(arrays, kinds, strict=True)])

    rows = df.select(x.alias("_x"), *[c.alias(n) for n, c in columns.items()])
    return rows.mapInArrow(pack, "kinds string, parts array<binary>").rdd.map(unpack)

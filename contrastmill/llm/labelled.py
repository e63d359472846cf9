"""Labels for training: which rows are held out, and a bounded sample of the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# what a pass over labelled texts returns
TRAINING = "code long, label int, part int, features array<float>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """``doc_id, label, part`` of up to ``most`` documents that are not held out, chosen by a hash of their id.

    A document with several labels has the largest. ``part`` (0 to 9) deals them to folds.
    """
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    code = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    rows = rows.withColumn("code", code).orderBy("code", "doc_id").limit(most)
    return rows.select("doc_id", "label", F.pmod("code", F.lit(10)).cast("int").alias("part"), "code")


def with_features(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
    """A batch of labelled texts as rows of ``TRAINING``."""
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(offsets, x.astype(np.float32).ravel())
    names = ["code", "label", "part"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "features"])


def with_score(batch: pa.RecordBatch, scores: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])


def scored_schema(docs: DataFrame, name: str) -> StructType:
    return StructType([*docs.schema.fields, StructField(name, DoubleType())])


def training_rows(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, labels and parts of rows of ``TRAINING``; repeated rows do not raise the bound."""
    table = rows.orderBy("code", "features").limit(most).toArrow()
    x = table.column("features").combine_chunks()
    width = len(x.flatten()) // max(1, len(x))
    return (
        x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width).astype(np.float64),
        table.column("label").to_numpy().astype(np.float64),
        table.column("part").to_numpy(),
    )

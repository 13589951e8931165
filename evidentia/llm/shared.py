"""Shared-folder tables for jobs that must survive a lost executor."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from evidentia.session import materialize, shared_dir

__all__ = ["BATCH_BYTES", "FILTER_BITS", "SMALL_BATCH_BYTES", "are_set", "bit_of", "bits_of", "bound_batches", "mapped", "materialize", "may_be_among", "scratch_path", "shared_dir", "table", "written"]

#: Bytes, about, that a Python worker gets at once.
BATCH_BYTES = 16 << 20
#: The same for jobs of many stages: workers are reused and keep much of the memory of their largest batch.
SMALL_BATCH_BYTES = 4 << 20
#: Bits of the filter that spares rows a shuffle.
FILTER_BITS = 1 << 23


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, Row]:
    """``materialize``, with ``rows`` and the given totals, which the write's own tasks gather.

    Reading them from the table would take further jobs, and each leaves plans
    and task records with the driver.
    """
    seen = Observation()
    found = F.count(F.lit(1)).alias("rows")
    out = materialize(df.observe(seen, found, *(c.alias(n) for n, c in totals.items())), name)
    return out, Row(**seen.get)


def bound_batches(spark: SparkSession, size: int) -> None:
    """Arrow batches of the jobs to come are bounded in bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One of the driver's tables."""
    bound_batches(spark, batch_bytes)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` for columns of any names (it takes a dot for a field's); ``apply`` reads them by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(apply, schema)


def bits_of(bits: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits in which each ``bit`` (long, from 0) is set: 1 MB at any input size."""
    places = bits.select((F.col("bit") + 1).alias("bit"))
    parts = places.groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    found = {r.bucket: r.bits for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()}
    width = 32768 // 8
    return b"".join(bytes(found.get(i + 1, b"")).ljust(width, b"\0") for i in range(FILTER_BITS // 32768))


def bit_of(key: Column) -> Column:
    """The place of ``key`` in a bitmap of ``FILTER_BITS``."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def are_set(bits: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` are set in a bitmap of ``bits_of``."""
    flags = np.frombuffer(bits, dtype=np.uint8)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def may_be_among(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` may be among ``keys``; never wrong about those that are.

    The bitmap is bounded, so it can be sent to every task. Where it fills up,
    more rows take the joined path. It takes a Python worker of its own: a task
    with other Python work should call ``are_set`` there.
    """
    held = keys.sparkSession.sparkContext.broadcast(bits_of(keys.select(bit_of(F.col("key")).alias("bit"))))

    @F.pandas_udf(BooleanType())
    def known(n: pd.Series) -> pd.Series:
        return pd.Series(are_set(held.value, n.to_numpy()))

    return known(bit_of(key))

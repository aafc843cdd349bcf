"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step works on at once; longer single rows go alone.
STEP_BYTES = 2 << 20


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is
    unset (as in tests on one machine) a temporary folder is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="trailspark-checkpoint-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        if sizes.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        if pa.types.is_list(sizes.type):
            lengths = [8 * n for n in pc.fill_null(pc.list_value_length(sizes), 0).to_pylist()]
        else:
            lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    h = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

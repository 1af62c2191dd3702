"""Where intermediate rows are kept: the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import cut_lineage, ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def freeze(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder: reads after a lost executor do not compute them anew."""
    return cut_lineage(df)


def store(df: DataFrame) -> DataFrame:
    """Like `freeze`, as compressed Parquet: for many narrow rows, or columns that are read apart."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame | None) -> None:
    """Delete the files of `store` once all that was made of them is written itself."""
    for df in stored:
        path = getattr(df, "stored_at", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


BITS, SPARE = 1 << 26, 64


class Cells:
    """Cells of a packed bitmap by number, taken modulo its size."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.last = packed, 8 * len(packed) - 1

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        cells = cells & self.last
        return ((self.packed[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)


def bit(column: Column) -> Column:
    """A value's place in a `bitmap`."""
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Which of BITS cells the column's values fall into, packed: eight megabytes at most, whatever the input.

    A clear cell proves that a value is absent, so rows can be passed over before a join; a set one proves nothing.
    """
    place = bit(F.col(column))
    rows = (values.select((place / 8).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), (place % 8).cast("int")).alias("flag"))
            .groupBy("byte").agg(F.bit_or("flag").alias("flags")).toArrow())
    return folded(rows)


def folded(rows: pa.Table) -> np.ndarray:
    """Packed cells from (byte, flags); halves are laid over each other while SPARE cells remain for each set one.

    Every bitmap is a file in the driver's folder and one in each executor's, so few values should take little.
    """
    out = np.zeros(BITS // 8, np.uint8)
    out[rows["byte"].to_numpy()] = rows["flags"].to_numpy()
    least = max(1 << 10, SPARE // 8 * int(np.bitwise_count(out).sum(dtype=np.int64)))
    while len(out) >= 2 * least:
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


def passed(df: DataFrame, key: str, cells: np.ndarray, present: bool) -> DataFrame:
    """Rows of `df` whose `key` falls into a set (or clear) cell."""
    sent = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cells(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(held[batch.column(batch.num_columns - 1).to_numpy()] == present))

    place = bit(F.col(key)).alias("  cell")
    return df.select("*", place).mapInArrow(run, df.select("*", place).schema).drop("  cell")

"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motifloom.sources.storage import settled as checkpoint
from motifloom.sources.storage import shared_folder, unused

from . import kernels

__all__ = ["binary", "bit_table", "checkpoint", "may_have", "over_slices", "record", "shared_folder", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_slices(work: Callable[[pa.Array, pa.RecordBatch], pa.RecordBatch | None], text: str = "text", size: int = kernels.SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``work(texts, rows)`` on slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = kernels.as_strings(batch.column(text))
            for at, part in kernels.slices(strings, size):
                out = work(part, batch.slice(at, len(part)))
                if out is not None and out.num_rows:
                    yield out

    return run


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of this schema; columns are arrays, NumPy arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits: which leading digits the 64-bit hashes ``h`` have.

    Merged from four tasks, so of fixed size on its way to the driver,
    whatever the number of hashes.
    """
    schema = pa.schema([("bits", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits - 3, dtype=np.uint8)
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(own, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        yield record(schema, binary([own]))

    out = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in hashes.select("h").repartition(4).mapInArrow(merge, "bits binary").collect():
        out |= np.frombuffer(r[0], dtype=np.uint8)
    return out


def may_have(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether a hash may be among those of a bit table: never false for one that is."""
    h = h >> np.uint64(64 - bits)
    return (table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def binary(rows: list[np.ndarray]) -> pa.Array:
    """Each array's bytes as one binary value."""
    return pa.array([x.tobytes() for x in rows], type=pa.binary())

"""Arrays that are too large for a copy in every Python worker: one file on each node, mapped into memory by all of them.

The driver writes an array to the shared folder, piece by piece; Spark brings the
file to every node once; tasks map it. Its pages belong to the node, not to a
worker: they are shared, read when touched, and given back under pressure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tokenloom.session import file_system, hadoop_path, scratch_dir

#: Bytes written at once.
PIECE = 4 << 20


@dataclass(frozen=True)
class MappedArray:
    """Where the file of an array is found on every node, and how to read it."""

    name: str
    dtype: str
    shape: tuple[int, ...]

    def open(self) -> np.ndarray:
        if 0 in self.shape:
            return np.zeros(self.shape, self.dtype)
        return np.memmap(SparkFiles.get(self.name), dtype=self.dtype, mode="r", shape=self.shape)


def share(spark: SparkSession, parts: Iterable[np.ndarray]) -> MappedArray:
    """One array, put together of ``parts`` of like rows, on every node. The driver holds one part at a time."""
    name = f"mapped-{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    stream = file_system(spark, path).create(hadoop_path(spark, path), True)
    rows, tail, dtype = 0, (), np.dtype(np.uint8)
    try:
        for part in parts:
            rows, tail, dtype = rows + len(part), part.shape[1:], part.dtype
            raw = memoryview(np.ascontiguousarray(part)).cast("B") if part.size else b""
            for begin in range(0, len(raw), PIECE):
                stream.write(bytearray(raw[begin : begin + PIECE]))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    return MappedArray(name, dtype.str, (rows, *tail))

"""A set of hashes as a bitmap of bounded size, which every task can hold: no member is missed, and few others pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as logarithms: at most 32 MB. With more members more others pass, which costs time only.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 28, 16
#: Bits for each member, where MOST_BITS allows.
SPARE = 32


def mixed(values: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64 bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found in batch.column("found"):
            bits = np.zeros(1 << CHUNK_BITS, dtype=bool)
            bits[found.values.to_numpy()] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "bits"])


def bitmap(members: DataFrame, n: int) -> Broadcast:
    """Broadcast of a packed bitmap that has the upper bits of each hash of members(hash); n: about how many there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(max(1, n) * SPARE - 1).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits)
    chunks = members.select(at.alias("at")).groupBy(F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(F.collect_set((F.col("at") % (1 << CHUNK_BITS)).cast("int")).alias("found"))
    packed = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (CHUNK_BITS - 3)
    for row in chunks.mapInArrow(_packed, "chunk long, bits binary").toLocalIterator():
        packed[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.uint8)
    return members.sparkSession.sparkContext.broadcast(packed)


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has."""
    at = hashes >> np.uint64(64 - (len(packed).bit_length() + 2))
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

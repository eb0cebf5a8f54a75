"""A bitmap of keys, sent to tasks so that they drop most rows of other keys before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest bitmap: 32 MB in a task and on the driver.
MAX_BITS = 1 << 28
_PART = 4096  # bytes of one part of a bitmap


class KeyFilter:
    """Tells which 64-bit keys a table may hold: all that it holds, and a few others.

    One bit for each hash, about 16 bits a key, but never more than ``MAX_BITS`` in all: a
    table of very many keys drops fewer of the other keys, and results don't
    depend on it. Keys must be well mixed (their high bits are the place).
    """

    def __init__(self, keys: DataFrame, column: str = "key"):
        spark = keys.sparkSession
        self.bits = min(MAX_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 65 - self.bits.bit_length()) + 1
        parts = (keys.groupBy(F.bitmap_bucket_number(place).alias("part"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow())
        bitmap = np.zeros(max(self.bits >> 3, _PART), dtype=np.uint8)
        for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
            bitmap[(part - 1) * _PART:part * _PART] = np.frombuffer(bits, dtype=np.uint8)
        self._bitmap = spark.sparkContext.broadcast(bitmap)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether each unsigned key may be in the table."""
        place = keys >> np.uint64(65 - self.bits.bit_length())
        return (self._bitmap.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def keep(self, rows: DataFrame, column: str, held: bool = True) -> DataFrame:
        """The rows whose key may be in the table, or the rows whose key is not."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.filter(pa.array(self.may_hold(keys) == held))

        return rows.mapInArrow(run, rows.schema)


#: Ids that are sent to every task in a join: 32 bytes each at most.
BROADCAST_IDS = 1 << 20


def without(rows: DataFrame, ids: DataFrame, column: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose ``column`` is not among ``ids`` (a written table of one column of that name). A few ids go to every
    task; of more, a bitmap does, and only the rows that it may hold are shuffled."""
    if ids.count() <= broadcast_ids:
        return rows.join(F.broadcast(ids), column, "left_anti").select(*rows.columns)
    place = F.xxhash64(column).alias("__place")
    held, placed = KeyFilter(ids.select(place), "__place"), rows.select("*", place)
    met = held.keep(placed, "__place").drop("__place").join(ids, column, "left_anti").select(*rows.columns)
    return held.keep(placed, "__place", held=False).drop("__place").union(met)

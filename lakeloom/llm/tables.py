"""Small helpers the operators share: checked broadcasts and array hash tables."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize

U8 = np.uint64
#: A join side is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its counted rows fit ``limit``; else as it is.

    Without the hint the join shuffles both sides and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Steps of a plan that neither repeat nor merge the rows of a file.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias")


def with_row_key(docs: DataFrame, columns: list[Column], label: str, key: str = "_row_") -> DataFrame:
    """``columns`` of ``docs`` and a 16-byte key of each row that is the same in every pass.

    Rows of a file are named by the file and their place in it, which does not
    depend on how files are cut into tasks. Rows that come from anything else, a
    join or a shuffle say, are numbered and written once, and read back in each pass.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_BY_ROW:
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        place = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
        try:
            return docs.select(F.unhex(F.md5(place)).alias(key), *columns)
        except AnalysisException:
            pass  # a source without places of rows
    number = F.monotonically_increasing_id().cast("string")
    return materialize(docs.select(F.unhex(F.md5(number)).alias(key), *columns), label)


class HashTable:
    """Open addressing in two arrays: 64-bit keys, never 0, to values above 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 8):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U8), np.zeros(1 << bits, np.int32)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        if (self.used + len(keys)) * 2 > len(self.keys):
            old = self.keys != 0
            keys = np.concatenate([self.keys[old], keys])
            values = np.concatenate([self.values[old], values.astype(np.int32)])
            while len(keys) * 2 > 1 << self.bits:
                self.bits += 1
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, U8), np.zeros(1 << self.bits, np.int32)
            self.used = 0
        self.used += len(keys)
        mask = U8(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & int(mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; 0 for those that are absent."""
        out = np.zeros(len(keys), np.int32)
        mask = len(self.keys) - 1
        slot = (keys & U8(mask)).astype(np.int64)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (found != 0))
        while len(left):
            at = (slot[left] + 1) & mask
            slot[left] = at
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (found != 0)]
        return out

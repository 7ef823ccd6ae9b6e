"""What the keyed operators on streams share: lists of rows in state, in blocks.

A row of a block costs no state access of its own: a micro-batch loads the blocks it needs and writes back those it changed. The
blocks lie in the RocksDB store, so a shard's rows need not fit the JVM, and a restart goes on from the last committed batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Rows in a block of state.
BLOCK = 512
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Keyed operators need the store that holds several variables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Blocks:
    """A list of rows by place, over a map of blocks."""

    def __init__(self, state):
        self.state = state
        self.loaded: dict[int, list] = {}
        self.changed: set[int] = set()

    def _block(self, b: int) -> list:
        if b not in self.loaded:
            self.loaded[b] = pickle.loads(self.state.getValue((b,))[0]) if self.state.containsKey((b,)) else []
        return self.loaded[b]

    def __getitem__(self, place: int) -> tuple:
        return self._block(place // BLOCK)[place % BLOCK]

    def put(self, place: int, row: tuple) -> None:
        """At a place that is there, or the next one."""
        block, at = self._block(place // BLOCK), place % BLOCK
        if at == len(block):
            block.append(row)
        else:
            block[at] = row
        self.changed.add(place // BLOCK)

    def forget(self, before: int) -> None:
        """Drops the blocks that lie wholly before a place."""
        for b in [b for b in self.loaded if (b + 1) * BLOCK <= before]:
            if self.state.containsKey((b,)):
                self.state.removeKey((b,))
            self.changed.discard(b)
            del self.loaded[b]

    def write(self) -> None:
        for b in sorted(self.changed):
            self.state.updateValue((b,), (pickle.dumps(self.loaded[b]),))


def lanes(df: DataFrame, shards: int, order: str) -> tuple[DataFrame, StructType]:
    """Rows dealt by a hash of their order into shards, which work side by side; the schema of what operators return."""
    if shards < 1:
        raise ValueError("a shard at least is needed")
    if taken := {"shard", "place"} & set(df.columns):
        raise ValueError(f"columns of that name are added: {', '.join(sorted(taken))}")
    if order not in df.columns:
        raise ValueError(f"missing column: {order}")
    shard = F.pmod(F.xxhash64(order), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)
    return df.withColumn("shard", shard), StructType([*df.schema.fields, StructField("shard", IntegerType()), StructField("place", LongType())])


def kept(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """shard, block, rows (pickled) of a list that a stopped query keeps in state."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    return rows.select(F.col("key.shard").alias("shard"), F.col("user_map_key.block").alias("block"), F.col("user_map_value.rows").alias("rows"))


def unpickled(batches: Iterator, make) -> Iterator:
    """For ``mapInPandas``: what ``make(shard, block, rows)`` gives for each block."""
    for batch in batches:
        for shard, block, rows in zip(batch["shard"], batch["block"], batch["rows"], strict=True):
            yield from make(int(shard), int(block), pickle.loads(rows))

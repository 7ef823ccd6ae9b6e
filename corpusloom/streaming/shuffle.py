"""Shuffling a stream through a buffer, and taking or skipping its first rows.

A shard's buffer fills first; from then on every new row takes the seat of one that leaves, and the seat is a hash of the seed,
the shard and the number of the departure, so the order is the same in every run, and after a restart, whatever the micro-batches
were. Rows of a micro-batch arrive in the order of a column. What the buffer holds when the query stops is read back from its
state (``remaining``), so every row comes out once.

Memory: ``buffer`` rows a shard, and a shard's part of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.streaming.state import BLOCK, Blocks, kept, lanes, stateful, unpickled

BUFFER = 16_384


def seat(seed: int, shard: int, number: int | str, size: int) -> int:
    """Whose row leaves: a seeded hash of the departure's number."""
    return int(md5(f"{seed}-{shard}-{number}".encode()).hexdigest()[:15], 16) % size


class Reservoir(StatefulProcessor):
    def __init__(self, buffer: int, seed: int, columns: list[str], order: str):
        self.buffer, self.seed, self.order = buffer, seed, columns.index(order)
        self.made = Row(*columns, "shard", "place")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.blocks = handle.getMapState("buffer", "block int", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        shard, seen, seats = key[0], self.seen.get()[0] if self.seen.exists() else 0, Blocks(self.blocks)
        for row in sorted((tuple(r)[:-1] for r in rows), key=lambda r: r[self.order]):
            if seen < self.buffer:
                seats.put(seen, row)
            else:
                place = seen - self.buffer
                i = seat(self.seed, shard, place, self.buffer)
                yield self.made(*seats[i], shard, place)
                seats.put(i, row)
            seen += 1
        seats.write()
        self.seen.update((seen,))

    def close(self) -> None:
        pass


def shuffled(df: DataFrame, order: str, buffer: int = BUFFER, seed: int = 42, shards: int = 1) -> DataFrame:
    """The stream's rows as they leave the buffers, with ``shard`` and ``place`` (their order in the shard).

    ``order`` sorts a micro-batch's rows (null is an error) and deals them into shards; each shard has a buffer of its own.
    """
    if buffer < 1:
        raise ValueError("a buffer holds a row at least")
    stateful(df.sparkSession)
    rows, schema = lanes(df, shards, order)
    return rows.groupBy("shard").transformWithState(Reservoir(buffer, seed, df.columns, order), schema, "append", "none")


def remaining(spark: SparkSession, checkpoint: str, schema: StructType, seed: int = 42) -> DataFrame:
    """What the buffers of a stopped query hold, in a seeded order behind the rows that left; ``schema`` is that of the stream."""
    columns = schema.fieldNames()
    layout = StructType([*schema.fields, StructField("shard", IntegerType()), StructField("__seat", IntegerType())])

    def run(batches):
        def make(shard, block, rows):
            yield pd.DataFrame([(*r, shard, block * BLOCK + i) for i, r in enumerate(rows)], columns=[*columns, "shard", "__seat"])

        yield from unpickled(batches, make)

    rows = kept(spark, checkpoint, "buffer").mapInPandas(run, layout)
    seen = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint).select(F.col("key.shard").alias("shard"), F.col("value.n").alias("__seen"))
    held = rows.join(F.broadcast(seen), "shard")  # a row per shard
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("shard"), F.lit("rest"), F.col("__seat")))
    rank = F.expr("row_number() over (partition by shard order by __key)") - 1
    size = F.expr("count(*) over (partition by shard)")
    placed = held.withColumn("__key", key).withColumn("place", (F.col("__seen") - size + rank).cast("long"))
    return placed.select(*columns, "shard", "place")


def _turn(shards: int):
    return F.col("place") * shards + F.col("shard")


def taken(df: DataFrame, n: int, shards: int = 1) -> DataFrame:
    """The first n rows of the shuffled order, shards in turn."""
    return df.filter(_turn(shards) < n)


def skipped(df: DataFrame, n: int, shards: int = 1) -> DataFrame:
    """All rows but the first n."""
    return df.filter(_turn(shards) >= n)


def plain(rows: Iterable, buffer: int, seed: int = 42, shard: int = 0) -> Iterator:
    """The order that one shard gives, for a list at hand."""
    held: list = []
    for n, row in enumerate(rows):
        if len(held) < buffer:
            held.append(row)
        else:
            i = seat(seed, shard, n - buffer, buffer)
            yield held[i]
            held[i] = row
    yield from (held[i] for i in sorted(range(len(held)), key=lambda i: md5(f"{seed}-{shard}-rest-{i}".encode()).hexdigest()))

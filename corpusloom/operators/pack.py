"""Packing of encoded rows inside batches, and collation: greedy knapsack, assembly, padding, pair and feedback layouts."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import IGNORE
from corpusloom.functions.tokens import padded
from corpusloom.operators.encode import PAD_ID


def greedy_bins(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item: a bin repeatedly takes the longest item that still fits; of equal ones, the last in the list first."""
    if any(n > capacity for n in lengths):
        raise ValueError("an item is longer than the capacity")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    sizes = [lengths[i] for i in order]
    bins, k = [0] * len(lengths), 0
    while order:
        left = capacity
        while (at := bisect_right(sizes, left) - 1) >= 0:
            left -= sizes.pop(at)
            bins[order.pop(at)] = k
        k += 1
    return bins


def knapsack(df: DataFrame, capacity: int, batch: str = "batch_id", order: str = "row_idx", ids: str = "input_ids") -> DataFrame:
    """Rows that fit, with ``bin`` and ``seat`` (place in the bin: longest first); one task per batch of fixed size."""
    kinds = dict(df.dtypes)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)
        rows["bin"] = greedy_bins(rows["n"].tolist(), capacity)
        return rows[[batch, order, "bin"]]

    slim = df.select(batch, order, F.size(ids).alias("n")).filter(F.col("n") <= capacity)
    placed = slim.groupBy(batch).applyInPandas(place, f"{batch} {kinds[batch]}, {order} {kinds[order]}, bin long")
    seat = F.row_number().over(Window.partitionBy(batch, "bin").orderBy(F.desc(F.size(ids)), F.desc(order))) - 1
    return df.join(placed, [batch, order]).withColumn("seat", seat)


def assembled(df: DataFrame, cutoff_len: int, neat: bool, batch: str = "batch_id") -> DataFrame:
    """One row per bin: input_ids, labels, attention_mask, position_ids of width cutoff_len + 1.

    The mask numbers the items from 1 (neat) or is 1 throughout, the padding included.
    """
    item = F.struct("seat", "input_ids", "labels")
    rows = df.groupBy(batch, "bin").agg(F.array_sort(F.collect_list(item)).alias("__items"))

    def flat(f) -> Column:
        return F.flatten(F.transform("__items", f))

    width = cutoff_len + 1
    out = rows.withColumns({
        "input_ids": flat(lambda x, i: x["input_ids"]), "labels": flat(lambda x, i: x["labels"]),
        "position_ids": flat(lambda x, i: F.when(F.size(x["input_ids"]) > 0, F.sequence(F.lit(0), F.size(x["input_ids"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))),
        "attention_mask": flat(lambda x, i: F.array_repeat((i + 1) if neat else F.lit(1), F.size(x["input_ids"]))),
    })
    gap = F.lit(width) - F.size("input_ids")
    short = F.when(gap < 0, F.raise_error(F.lit("a packed row is too long")).cast("int")).otherwise(gap)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("__gap")))
    out = out.withColumn("__gap", short)
    pads = {"input_ids": PAD_ID, "labels": IGNORE, "position_ids": 0, "attention_mask": 0 if neat else 1}
    return out.withColumns({c: fill(c, v) for c, v in pads.items()}).drop("__gap", "__items")


def collated(df: DataFrame, batch: str = "batch_id", multiple: int = 8) -> DataFrame:
    """input_ids, attention_mask and labels padded on the right to a common width per batch."""
    for column, pad in (("attention_mask", 0), ("labels", IGNORE), ("input_ids", PAD_ID)):
        df = padded(df, column, pad, batch, multiple)
    return df


def pair_rows(df: DataFrame, batch: str = "batch_id", order: str = "row_idx", multiple: int = 8) -> DataFrame:
    """Two rows per pair: all chosen ones of a batch, then all rejected; padded together."""
    parts = ("input_ids", "attention_mask", "labels")
    sides = [df.select(batch, order, F.lit(k).alias("side"), *(F.col(f"{side}_{p}").alias(p) for p in parts)) for k, side in enumerate(("chosen", "rejected"))]
    both = sides[0].unionByName(sides[1])
    place = F.row_number().over(Window.partitionBy(batch).orderBy("side", order)) - 1
    return collated(both.withColumn("place", place), batch, multiple)


def feedback_rows(df: DataFrame, batch: str = "batch_id", multiple: int = 8) -> DataFrame:
    """Own and kl_ sequences side by side, each padded to its own width."""
    for prefix in ("", "kl_"):
        for column, pad in ((f"{prefix}attention_mask", 0), (f"{prefix}labels", IGNORE), (f"{prefix}input_ids", PAD_ID)):
            df = padded(df, column, pad, batch, multiple)
    return df

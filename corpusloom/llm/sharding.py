"""Shards of near equal size by sampled splitters.

Records are ordered by a key that puts equal texts side by side. A sample of keys, drawn in proportion to size (half of the
weight) and to rows (the other half), is cut into many more ranges than there are shards. The ranges are measured over all
records; those that came out overfull are sampled and cut again, first between groups of equal texts, then, where one group is
all that is left, inside it. So no task ever orders more than about two shares of a range, whatever the keys are. Running sums
inside the ranges give every record its place among all, and the place gives the shard; what the sample says changes the
balance of the tasks and nothing else.

Laws: ``bytes``: the shard of the middle of the record's bytes. Equal texts stay together if they fill no more than
``1 / WHOLE`` of a shard; larger groups may be cut where a shard ends. ``rows``: the shard of the record's number, so counts
differ by one at most.

Defined cases: a null text counts as an empty one, of size 1 and CRC 0; a null id is an id like others; repeated rows are
records of their own (ties go by row, so which of two equal rows comes first has no meaning); a text is read once, by the JVM,
however long; with fewer records than shards some stay empty; an empty table gives an empty result. Only the id and text
columns are read, other columns travel in one struct if asked for, so they can have any name.

The driver holds ``DRAWN`` keys of 48 letters for each range, a range being at least ``1 / (WHOLE * shards)`` of the records
or a million rows, so 16 keys in a million rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ._common import stored

#: A group of equal texts above this part of a shard may be cut; ranges to a shard; rows of a range; keys drawn for each range.
WHOLE, RANGE_ROWS, DRAWN = 64, 1_000_000, 16
#: Letters of the group in a key; a letter above all others there.
GROUP, ABOVE = 16, "g"
MAX_ROUNDS = 30


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, size, text_crc32, k (the key: group of the text, hash of the id, row) and, on demand, the struct ``row``, written to the shared folder."""
    text, row_id = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.concat(F.substring(F.md5(text), 1, GROUP), F.substring(F.md5(row_id), 1, 16), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("k"), *rest)
    return stored(slim, "records")


def _placed(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """``range``: how many cuts are at or below the key."""
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    edges = np.array(cuts, dtype="S48")
    at = rows.columns.index("k")

    def run(batches):
        for batch in batches:
            keys = np.array(batch.column(at).to_pylist(), dtype="S48")
            yield batch.append_column("range", pa.array(np.searchsorted(edges, keys, side="right").astype(np.int32)))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("range", IntegerType())]))


def _weight(total: int, n: int):
    """A record's part of all, half by bytes and half by rows."""
    return F.col("size") / (2.0 * total) + F.lit(0.5 / n)


def _sample(rows: DataFrame, weight, wanted: float, seed: int) -> tuple[list[str], np.ndarray]:
    """Drawn keys in order, and how much of the whole each stands for; about ``wanted`` of the whole."""
    drawn = rows.select("k", weight.alias("w")).filter(F.rand(seed) < F.col("w") * wanted).collect()
    drawn.sort(key=lambda r: r["k"])
    return [r["k"] for r in drawn], np.array([max(r["w"], 1 / wanted) for r in drawn])


def _quantiles(keys: list[str], weights: np.ndarray, share: float, inside: bool) -> set[str]:
    """Where the running weight passes a multiple of ``share``: the beginning of a group, or a place in it."""
    step = np.floor(np.cumsum(weights) / share)
    at = np.flatnonzero(np.diff(step, prepend=0) > 0)
    cuts: set[str] = set()
    for i in at:
        group = keys[i][:GROUP]
        cuts |= {keys[i]} if inside else {group}
        if not inside and weights[i] >= share or (i and not inside and keys[i - 1][:GROUP] == group):
            cuts.add(group + ABOVE)  # a group of several drawn keys may be large: it gets a range of its own
    return cuts


def ranges(rows: DataFrame, total: int, n: int, shards: int) -> tuple[list[str], list, dict[int, tuple[int, int]]]:
    """Cuts; for each range its number, bytes and rows; and the (bytes before, bytes) of the group that a cut range belongs to."""
    share = 1 / max(WHOLE * shards, -(-n // RANGE_ROWS))
    weight = _weight(total, n)
    keys, weights = _sample(rows, weight, DRAWN / share, 11)
    cuts = _quantiles(keys, weights, share, False)
    whole: dict[str, int] = {}  # groups that are cut inside, and their bytes
    for turn in range(MAX_ROUNDS):
        ordered = sorted(cuts)
        placed = _placed(rows, ordered)
        group = F.substring("k", 1, GROUP)
        found = placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(group).alias("low"), F.max(group).alias("high"), F.min("k").alias("k")).orderBy("range").collect()
        part = lambda r: r["size"] / (2.0 * total) + 0.5 * r["n"] / n
        over = [r for r in found if part(r) > 2 * share and r["n"] > 1 and (r["low"] != r["high"] or r["n"] > 2)]
        if not over or turn == MAX_ROUNDS - 1:
            break
        before = len(cuts)
        drawn = _sample(placed.filter(F.col("range").isin([r["range"] for r in over])), weight, DRAWN / share * 2 ** min(turn, 6), 12 + turn)
        for r in over:
            alone = r["low"] == r["high"]
            if alone:
                whole.setdefault(r["low"], r["size"])
            lo, hi = (ordered[r["range"] - 1] if r["range"] else ""), (ordered[r["range"]] if r["range"] < len(ordered) else "~")
            own = [i for i, k in enumerate(drawn[0]) if lo <= k < hi]
            cuts |= _quantiles([drawn[0][i] for i in own], drawn[1][own], share, alone)
        if len(cuts) == before:
            break
    starts, at = {}, 0
    groups: dict[int, tuple[int, int]] = {}
    for r in found:
        if r["low"] == r["high"] and r["low"] in whole:
            starts.setdefault(r["low"], at)
            groups[r["range"]] = starts[r["low"]], whole[r["low"]]
        at += r["size"]
    return ordered, [(r["range"], r["size"], r["n"]) for r in found], groups


def sharded(docs: DataFrame, shards: int = 16, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null: these laws move rows between shards), and ``row`` with the columns to carry."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    if shards < 1:
        raise ValueError("a shard at least is needed")
    spark = docs.sparkSession
    rows = records(docs, id_col, text_col, carry)
    sums = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, n = sums["b"] or 0, sums["n"]
    if not n:
        empty = rows.select("id", "size", "text_crc32", F.lit(law).alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))
        return empty
    cuts, found, groups = ranges(rows, total, n, shards)
    table, bytes_before, rows_before = [], 0, 0
    for i, size, count in found:  # as many rows as ranges
        of = groups.get(i)
        kept = of is not None and of[1] * WHOLE * shards <= total
        table.append((i, bytes_before, rows_before, of is not None, min(shards - 1, (2 * of[0] + of[1]) * shards // (2 * total)) if kept else None))
        bytes_before, rows_before = bytes_before + size, rows_before + count
    offsets = F.broadcast(spark.createDataFrame(table, "range int, bytes_before long, rows_before long, inside boolean, fixed int"))
    local, group = Window.partitionBy("range").orderBy("k"), Window.partitionBy("range", F.substring("k", 1, GROUP))
    placed = _placed(rows, cuts).join(offsets, "range")
    number = F.col("rows_before") + F.row_number().over(local) - 1
    placed = placed.withColumns({"number": number.cast("long"), "start": F.col("bytes_before") + F.sum("size").over(local) - F.col("size")})
    if law == "rows":
        shard = F.expr(f"number * {shards} div {n}")
    else:
        placed = placed.withColumns({"group_size": F.sum("size").over(group), "group_start": F.min("start").over(group)})
        together = ~F.col("inside") & (F.col("group_size") * (WHOLE * shards) <= total)
        twice = F.when(together, 2 * F.col("group_start") + F.col("group_size")).otherwise(2 * F.col("start") + F.col("size"))
        # in two steps, as the product of a place and the shards could pass 64 bits
        middle = F.least(F.floor(twice.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(20,0)")), F.lit(shards - 1))
        shard = F.coalesce("fixed", middle)
    done = stored(placed.withColumn("shard", shard.cast("int")).select("id", "size", "text_crc32", "shard", "number", *(["row"] if carry else [])), "shards")
    first = {r["shard"]: r["f"] for r in done.groupBy("shard").agg(F.min("number").alias("f")).collect()}  # a row per shard
    firsts = F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(shards)))
    slot = F.col("number") - F.element_at(firsts, F.col("shard") + 1)
    return done.select("id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))


def write_shards(rows: DataFrame, path: str, files: int) -> None:
    """Rows of ``sharded`` (with ``row``) as Parquet, a folder per shard; files follow the slots, and a shard may have many."""
    ordered = rows.select("shard", "slot", "row").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def sharding(docs: DataFrame) -> DataFrame:
    """Every row of ``documents`` in one of 16 shards of near equal bytes."""
    return sharded(docs).withColumnRenamed("id", "doc_id")

"""Preparation of streams: align, mix, shuffle through a buffer, take the first rows for validation, encode row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DataArgs, DatasetSpec, RunSpec, check_run, check_stage
from corpusloom.operators import encode
from corpusloom.operators.align import align
from corpusloom.operators.prepare import Module, processor
from corpusloom.streaming import mixing, shuffle


def prepare_stream(
    run: RunSpec, args: DataArgs, streams: dict[str, tuple[DatasetSpec, DataFrame]], evaluation: dict[str, tuple[DatasetSpec, DataFrame]] | None = None,
    buffer: int = shuffle.BUFFER, sizes: list[int] | None = None, extras: encode.Extras = encode.Extras(),
) -> Module:
    """The splits of streams whose rows have a ``row_idx``. What looks at a batch of rows (packing, chunks, the kto stage) is for ``per_batch``.

    The validation rows are the first ``val_size`` that leave the buffer, training rows all later ones; both read the same seeded
    order, each in a query and with a checkpoint of its own. Evaluation streams are shuffled likewise, or stay apart to predict on.
    """
    check_run(run, args)
    if not args.streaming:
        raise ValueError("these arguments are for tables")
    if run.tokenized:
        raise ValueError("a stream is not stored before it is used")
    if (args.packing and run.stage == "sft") or run.stage == "kto" or (run.stage == "pt" and args.packing is not False):
        raise ValueError("this stage looks at batches of rows: use per_batch")

    def aligned(found: dict[str, tuple[DatasetSpec, DataFrame]]) -> list[DataFrame]:
        for spec, _ in found.values():
            check_stage(run.stage, spec.ranking)
        return [align(rows, spec) for spec, rows in found.values()]

    def mixed(tables: list[DataFrame]) -> DataFrame:
        if len(tables) == 1:
            return tables[0]
        if args.mix_strategy == "concat":
            return mixing.concatenated(tables).drop("src_idx")
        probabilities = list(args.interleave_probs) if args.interleave_probs else None
        turns = mixing.interleaved(tables, "row_idx", args.mix_strategy, probabilities, run.seed, sizes)
        return turns.drop("row_idx").withColumnRenamed("place", "row_idx").select(*tables[0].columns)

    def encoded(rows: DataFrame, evaluation: bool = False) -> DataFrame:
        return processor(run, args, evaluation)(rows, run, args, extras)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.drop("shard", "row_idx").withColumnRenamed("place", "row_idx")

    order = shuffle.shuffled(mixed(aligned(streams)), "row_idx", buffer, run.seed)
    n = int(args.val_size)
    train = encoded(numbered(shuffle.skipped(order, n) if n else order))
    if evaluation and run.predict:
        return Module(train, {k: encoded(rows, True) for k, rows in zip(evaluation, aligned(evaluation), strict=True)})
    if evaluation:
        return Module(train, encoded(numbered(shuffle.shuffled(mixed(aligned(evaluation)), "row_idx", buffer, run.seed)), True))
    return Module(train, encoded(numbered(shuffle.taken(order, n))) if n else None)


def rest(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras = encode.Extras()) -> DataFrame:
    """Encoded rows of what a buffer holds in the end (``shuffle.remaining``)."""
    return processor(run, args)(rows.drop("shard", "row_idx").withColumn("row_idx", F.col("place")).drop("place"), run, args, extras)

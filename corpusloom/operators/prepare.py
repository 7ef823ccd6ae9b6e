"""From named datasets to encoded splits: load, sample, align, mix, encode for a stage, split.

All of it is one lazy plan per split. Rows are numbered once, where they are read; samples, mixtures and splits are filters and
sums over that number, so nothing is sorted twice. Sampling comes before alignment, so rows that are not drawn are never
converted. A validation share of exactly k rows is cut by a key: the k-th smallest seeded key of the encoded rows is found over
their numbers alone, which are worked out once and kept on the executors' disks meanwhile (blocks have a number only when their
tokens are counted). Both splits are then filters on that key; ``Module.marked`` has them in one table, encoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DataArgs, DatasetSpec, RunSpec, check_run, check_stage
from corpusloom.operators import encode, mix, pack
from corpusloom.operators.align import align, aligned_media
from corpusloom.sources import catalog

#: A dataset by name: its specification, and its rows if they are at hand.
Tables = Mapping[str, tuple[DatasetSpec, DataFrame | None]]
Stage = Callable[[DataFrame, RunSpec, DataArgs, encode.Extras], DataFrame]
_STAGES: dict[str, Stage] = {}
#: Blocks of a batch come after one another in the number of a chunked row.
BLOCKS = 1 << 32


def register_stage(name: str, f: Stage) -> None:
    """``f`` makes encoded rows, numbered by a unique ``row_idx``, of aligned ones."""
    if name in _STAGES:
        raise ValueError(f"stage {name} exists")
    _STAGES[name] = f


def processor(run: RunSpec, args: DataArgs, evaluation: bool = False) -> Stage:
    """Which work a stage does on a split: what is to be generated is encoded without its answer."""
    if run.stage == "ppo" or (run.stage == "sft" and run.generate and evaluation):
        return _STAGES["unsupervised"]
    if run.stage == "sft" and args.packing:
        return _STAGES["packed"]
    return _STAGES[run.stage]


def _pretraining(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    """Texts with an end token; by default all texts of a batch end to end, in blocks."""
    text = F.get("_prompt", F.lit(0))["content"]
    if args.packing is False:
        out = encode.pretrain_ids(rows, text, run.tokenizer, add_bos=run.add_bos, cutoff=args.cutoff_len)
    else:
        ids = encode.batched(encode.pretrain_ids(rows, text, run.tokenizer), args.batch_size)
        out = encode.chunks(ids, args.capacity, bos_id=encode.BOS_ID if run.add_bos else None).withColumn("row_idx", F.col("batch_id") * BLOCKS + F.col("block"))
    return out.select("row_idx", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"))


def _supervised(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    return encode.supervised(rows, run.template, args, run.tokenizer, run.eos, extras).select("row_idx", "input_ids", "attention_mask", "labels", *_media(rows))


def _packed(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    """Rows of a batch side by side, in bins; a bin's number is that of its place in the batch."""
    ids = encode.batched(encode.supervised(rows, run.template, args, run.tokenizer, run.eos, extras), args.batch_size)
    bins = pack.assembled(pack.knapsack(ids.select("row_idx", "batch_id", "input_ids", "labels"), args.capacity), args.capacity, bool(args.neat_packing))
    return bins.select((F.col("batch_id") * args.batch_size + F.col("bin")).alias("row_idx"), "input_ids", "attention_mask", "position_ids", "labels")


def _pairs(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    out = encode.pairwise(rows, run.template, args, run.tokenizer, run.eos, extras)
    return out.select("row_idx", *(f"{side}_{part}" for side in ("chosen", "rejected") for part in ("input_ids", "attention_mask", "labels")), *_media(rows))


def _feedback(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    out = encode.feedback(rows, run.template, args, run.tokenizer, run.eos, extras)
    return out.select("row_idx", *(f"{side}{part}" for side in ("", "kl_") for part in ("input_ids", "attention_mask", "labels")), "kto_tags", *_media(rows))


def _unsupervised(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras) -> DataFrame:
    return encode.unsupervised(rows, run.template, args, run.tokenizer, run.eos, extras).select("row_idx", "input_ids", "attention_mask", "labels", *_media(rows))


def _media(rows: DataFrame) -> list[Column]:
    return [F.col(f"_{m}").alias(m) for m in aligned_media if f"_{m}" in rows.columns]


for _name, _f in {"pt": _pretraining, "sft": _supervised, "packed": _packed, "rm": _pairs, "kto": _feedback, "unsupervised": _unsupervised}.items():
    register_stage(_name, _f)


# --- from names to one table ---------------------------------------------------------------------------------------


def positioned(rows: DataFrame) -> DataFrame:
    """``row_idx`` by file, block and place in it; rows that have one keep it."""
    if "row_idx" in rows.columns:
        return rows
    place = F.monotonically_increasing_id()
    try:
        at = rows.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), place.alias("place")).alias("__at"))
    except AnalysisException:  # not rows of files as they are: by partition
        at = rows.withColumn("__at", place)
    return mix.numbered(at, "__at").drop("__at")


def sample(rows: DataFrame, spec: DatasetSpec, args: DataArgs, seed: int) -> tuple[DataFrame, int]:
    """The rows that take part, numbered anew, and how many they are: as many as the catalogue says, then the first ``max_samples``."""
    if spec.num_samples is not None:
        rows, n = mix.sampled(rows, spec.num_samples, seed).drop("row_idx").withColumnRenamed("sample_idx", "row_idx"), spec.num_samples
    else:
        n = rows.count()
    if args.max_samples is not None:
        rows, n = mix.first_rows(rows, args.max_samples), min(n, args.max_samples)
    return rows, n


def resolve(spark: SparkSession, names: tuple[str, ...], folder: str, tables: Tables | None) -> dict[str, tuple[DatasetSpec, DataFrame]]:
    """Specifications and rows of the named datasets, in order; rows at hand come before the catalogue in ``folder``."""
    tables = tables or {}
    specs = {s.name: s for s in catalog.datasets(spark, [n for n in names if n not in tables], folder)}
    found = {}
    for n in names:
        spec, rows = tables[n] if n in tables else (specs[n], None)
        found[n] = spec, catalog.load(spark, spec, folder) if rows is None else rows
    return found


def merged(found: dict[str, tuple[DatasetSpec, DataFrame]], run: RunSpec, args: DataArgs, folder: str, apart: bool = False) -> DataFrame | dict[str, DataFrame]:
    """Aligned rows of all datasets, numbered by ``row_idx`` in the order of the mixture, or a table per dataset."""
    parts: dict[str, tuple[DataFrame, int]] = {}
    for name, (spec, rows) in found.items():
        check_stage(run.stage, spec.ranking)
        drawn, n = sample(positioned(rows), spec, args, run.seed)
        parts[name] = align(drawn, spec, args.media_dir or folder), n
    if apart:
        return {name: rows for name, (rows, _) in parts.items()}
    tables = [rows for rows, _ in parts.values()]
    if len(tables) == 1:
        return tables[0]
    if args.mix_strategy == "concat":
        ahead, numbered = 0, []
        for rows, n in parts.values():
            numbered.append(rows.withColumn("row_idx", F.col("row_idx") + F.lit(ahead).cast("long")))
            ahead += n
        return reduce(DataFrame.unionByName, numbered)
    probabilities = list(args.interleave_probs) if args.interleave_probs else None
    taken = mix.interleaved(tables, args.mix_strategy, probabilities, run.seed)
    return taken.drop("row_idx", "src_idx").withColumnRenamed("mix_idx", "row_idx")


# --- from one table to splits --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Module:
    """What a run reads. ``evaluation`` is a table, a table per dataset, or nothing."""

    train: DataFrame | None = None
    evaluation: DataFrame | dict[str, DataFrame] | None = None
    #: Both splits of a divided table, told apart by a column ``split`` (train, validation).
    marked: DataFrame | None = None

    def splits(self) -> dict[str, DataFrame]:
        """By name: train, validation, or validation_<dataset>."""
        out = {"train": self.train} if self.train is not None else {}
        if isinstance(self.evaluation, dict):
            return out | {f"validation_{k}": v for k, v in self.evaluation.items()}
        return out | ({"validation": self.evaluation} if self.evaluation is not None else {})

    @classmethod
    def of(cls, splits: dict[str, DataFrame]) -> Module:
        """The module of named splits: a whole validation split comes before those of single datasets."""
        apart = {k.removeprefix("validation_"): v for k, v in splits.items() if k.startswith("validation_")}
        return cls(splits.get("train"), splits.get("validation", apart or None))


def cut(rows: DataFrame, val_size: float, seed: int) -> Column:
    """Which rows validate: exactly ``val_size`` of them, or that share rounded up, by a seeded order of ``row_idx``. No row at all is an error."""
    key = mix.random_key(seed, "row_idx")
    keys = rows.select("row_idx").persist(StorageLevel.DISK_ONLY)
    try:
        n = keys.count()
        if not n:
            raise LookupError("no row to divide")
        take = min(n, int(val_size) if val_size >= 1 else -(-int(n * val_size * 10**9) // 10**9))
        if not take:
            return F.lit(False)
        last = mix.numbered(keys, key, "row_idx", out="__rank").filter(F.col("__rank") == take - 1).select(key.alias("k"), "row_idx").first()
    finally:
        keys.unpersist()
    return (key < last["k"]) | ((key == last["k"]) & (F.col("row_idx") <= last["row_idx"]))


def _nothing(run: RunSpec) -> RuntimeError:
    return RuntimeError("not enough text for one block" if run.stage == "pt" else "no valid row; look at the format of the data")


def encoded(rows: DataFrame, run: RunSpec, args: DataArgs, evaluation: bool = False, extras: encode.Extras = encode.Extras()) -> DataFrame:
    """Encoded rows of a split; none at all is an error."""
    out = processor(run, args, evaluation)(rows, run, args, extras)
    if out.isEmpty():
        raise _nothing(run)
    return out


def divided(rows: DataFrame, run: RunSpec, args: DataArgs, extras: encode.Extras = encode.Extras()) -> Module:
    """The encoded rows in two splits; none at all is an error."""
    out = processor(run, args)(rows, run, args, extras)
    try:
        chosen = cut(out, args.val_size, run.seed)
    except LookupError:
        raise _nothing(run) from None
    marked = out.withColumn("split", F.when(chosen, "validation").otherwise("train"))
    return Module(out.filter(~chosen), out.filter(chosen), marked)


def prepare(spark: SparkSession, run: RunSpec, args: DataArgs, folder: str = ".", tables: Tables | None = None, extras: encode.Extras = encode.Extras()) -> Module:
    """The encoded splits of a run.

    Stored rows, if ``run.tokenized`` has any, are taken as they are. A specification that excludes itself is an error, before
    anything is read. Streams are prepared by ``corpusloom.streaming``.
    """
    check_run(run, args)
    if args.streaming:
        raise ValueError("streams are prepared by corpusloom.streaming")
    if run.tokenized and (stored := reloaded(spark, run.tokenized)):
        return stored
    rows = merged(resolve(spark, args.datasets, folder, tables), run, args, folder) if args.datasets else None
    if rows is not None and not args.eval_datasets and args.val_size > 1e-6:
        module = divided(rows, run, args, extras)
    else:
        train = encoded(rows, run, args, extras=extras) if rows is not None else None
        evaluation = None
        if args.eval_datasets:
            held = merged(resolve(spark, args.eval_datasets, folder, tables), run, args, folder, apart=run.predict)
            evaluation = {k: encoded(v, run, args, True, extras) for k, v in held.items()} if run.predict else encoded(held, run, args, True, extras)
        module = Module(train, evaluation)
    if run.tokenized:
        for name, rows in module.splits().items():
            rows.write.mode("errorifexists").parquet(f"{run.tokenized.rstrip('/')}/{name}")
        return reloaded(spark, run.tokenized)
    return module


def reloaded(spark: SparkSession, path: str) -> Module | None:
    """The splits stored at ``path``, a folder each; None if there are none."""
    splits = {f.rstrip("/").rpartition("/")[2]: f for f in catalog.listed(spark, path, missing=True)}
    known = {k: spark.read.parquet(f) for k, f in splits.items() if k in ("train", "validation") or k.startswith("validation_")}
    return Module.of(known) if known else None

"""The dataset catalogue and the scans it leads to."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DatasetSpec, check_stage
from corpusloom.sources.arrow_files import arrow
from corpusloom.sources.dialogues import BELLE, HH, parsed

PARTS = ("prompt", "query", "response", "history", "messages", "system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
TAGS = ("role_tag", "content_tag", "user_tag", "assistant_tag", "observation_tag", "function_tag", "system_tag")
#: How a file's name tells its format.
FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "txt": "text"}


def spec_of(name: str, entry: dict) -> DatasetSpec:
    """A catalogue entry as a specification: hub before script before file. Listed columns or tags replace all defaults."""
    hubs = [k for k in ("hf_hub_url", "ms_hub_url", "om_hub_url") if k in entry]
    source, location = ("hub", entry[hubs[0]]) if hubs else ("script", entry["script_url"]) if "script_url" in entry else ("file", entry["file_name"])
    spec = DatasetSpec(
        name, source, location, entry.get("subset"), entry.get("split", "train"), entry.get("folder"), entry.get("num_samples"), entry.get("formatting", "alpaca"), entry.get("ranking", False)
    )
    if "columns" in entry:
        spec = replace(spec, columns={p: entry["columns"].get(p) for p in PARTS})
    if "tags" in entry:
        spec = replace(spec, tags={t: entry["tags"].get(t) for t in TAGS})
    return spec


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, by Spark's own file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def datasets(spark: SparkSession, names: list[str] | None, folder: str) -> list[DatasetSpec]:
    """Specifications of the named datasets; an unknown name is an error. ``ONLINE``: every name is a hub's."""
    if not names:
        return []
    if folder == "ONLINE":
        return [DatasetSpec(n, "hub", n) for n in names]
    if folder.startswith("REMOTE:"):
        raise NotImplementedError("a remote catalogue needs a network")
    try:
        info = json.loads(read_text(spark, f"{folder.rstrip('/')}/dataset_info.json"))
    except Exception as e:
        raise ValueError(f"the catalogue in {folder} cannot be read: {e}") from e
    for n in names:
        if n not in info:
            raise ValueError(f"undefined dataset {n}")
    return [spec_of(n, info[n]) for n in names]


def checked(specs: list[DatasetSpec], stage: str) -> list[DatasetSpec]:
    for s in specs:
        check_stage(stage, s.ranking)
    return specs


def usable(specs: list[DatasetSpec], stage: str) -> list[DatasetSpec]:
    """Those that a stage can use, for lists to choose from."""
    return [s for s in specs if s.ranking == (stage == "rm")] if stage in ("rm", "pt", "sft") else specs


def listed(spark: SparkSession, path: str, missing: bool = False) -> list[str]:
    """A file, or what a folder holds, in order; a path that is not there is an error unless it may be ``missing``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        if missing:
            return []
        raise FileNotFoundError(path)
    if not system.getFileStatus(at).isDirectory():
        return [path]
    names = [str(s.getPath().toString()) for s in system.listStatus(at)]
    return sorted(n for n in names if not n.rpartition("/")[2].startswith(("_", ".")))


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, or a folder of files of one kind."""
    files = listed(spark, path)
    kinds = {FORMATS.get(f.rpartition(".")[2]) for f in files}
    if None in kinds or not kinds:
        raise ValueError(f"unknown kind of file in {path}")
    if len(kinds) > 1:
        raise ValueError("files should be of one kind")
    kind = kinds.pop()
    if kind == "arrow":
        return arrow(spark, files)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(files, header=True, multiLine=_over_lines(spark, files), escape='"')
    if kind in ("json", "jsonl"):
        return reader.json(files, multiLine=kind == "json")
    return reader.format(kind).load(files)


def _over_lines(spark: SparkSession, files: list[str]) -> bool:
    """Whether a record of a CSV file goes on over a line's end: then some line has an odd number of quotes. If none does, files can be split."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(files).filter(odd % 2 == 1).isEmpty()


def load(spark: SparkSession, spec: DatasetSpec, folder: str = ".") -> DataFrame:
    """The rows of a dataset; hubs need a network and are refused."""
    if spec.source == "hub":
        raise NotImplementedError(f"{spec.name} lies on a hub, which needs a network")
    path = spec.location if "/" in spec.location and spec.location.startswith(("/", "file:", "hdfs:", "s3")) else f"{folder.rstrip('/')}/{spec.location}"
    if spec.source == "script":
        return BUILDERS[spec.location.rpartition("/")[2]](spark, path)
    return scan(spark, path)


def reload_or(spark: SparkSession, path: str | None, build) -> DataFrame:
    """Stored encoded rows if there are any, else what ``build`` makes."""
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(at) and len(system.listStatus(at)):
            return spark.read.parquet(path)
    return build()


# --- builders -----------------------------------------------------------------------------------------------------


def _talk(turns: Column) -> Column:
    return F.transform(turns, lambda t, i: F.struct(F.when(i % 2 == 0, "human").otherwise("gpt").alias("from"), t.alias("value")))


def ultra_chat(spark: SparkSession, path: str) -> DataFrame:
    """Lists of turns: unreadable lines go, an odd last turn goes, fewer than two turns go."""
    rows = spark.read.text(path).select(F.from_json("value", "id string, data array<string>").alias("r")).filter("r.data is not null")
    n = F.size("r.data") - F.size("r.data") % 2
    return rows.select(_talk(F.slice("r.data", F.lit(1), n)).alias("conversations")).filter(F.size("conversations") >= 2)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def belle_multiturn(spark: SparkSession, path: str) -> DataFrame:
    """One text of a whole dialogue per row; its last question is answered by ``output``."""
    rows = spark.read.schema("instruction string, output string").json(path)
    told = rows.withColumn("__d", parsed(F.col("instruction"), BELLE))
    last = F.array(F.array(F.col("__d.question"), _strip(F.col("output"))))
    return told.select(_talk(F.flatten(F.concat("__d.history", last))).alias("conversations"))


def hh_rlhf(spark: SparkSession, path: str) -> DataFrame:
    """Two dialogues that differ in the last answer: instruction, chosen, rejected, history."""
    rows = spark.read.schema("chosen string, rejected string").json(path)
    told = rows.withColumns({"__c": parsed(F.col("chosen"), HH), "__r": parsed(F.col("rejected"), HH)})
    return told.select(F.col("__c.question").alias("instruction"), F.col("__c.answer").alias("chosen"), F.col("__r.answer").alias("rejected"), F.col("__c.history").alias("history"))


BUILDERS = {"ultra_chat": ultra_chat, "belle_multiturn": belle_multiturn, "hh_rlhf_en": hh_rlhf}

# --- benchmarks ---------------------------------------------------------------------------------------------------


def mmlu(spark: SparkSession, path: str) -> DataFrame:
    """Without a header: question, A, B, C, D, answer."""
    return spark.read.schema("question string, A string, B string, C string, D string, answer string").csv(path, multiLine=True, escape='"')


def ceval(spark: SparkSession, path: str) -> DataFrame:
    """With a header; answer and explanation may be missing."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in ("answer", "explanation")})


def cmmlu(spark: SparkSession, path: str) -> DataFrame:
    """With a header; the first column is a row number."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.drop(df.columns[0]).withColumnsRenamed({"Question": "question", "Answer": "answer"})


# --- logs, predictions, previews ----------------------------------------------------------------------------------


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prompt string, predict string, label string").json(path)


def last_log(df: DataFrame, order: str = "current_steps") -> DataFrame:
    """The row of the last step."""
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def page(df: DataFrame, number: int, size: int = 2) -> tuple[DataFrame, int]:
    """(the rows of a page by row_idx, how many rows there are)."""
    return df.filter(F.col("row_idx").between(number * size, number * size + size - 1)), df.count()


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(_strip(F.col("value")).alias("line"))

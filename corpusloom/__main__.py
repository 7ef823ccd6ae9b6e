"""Command line: ``python -m corpusloom METHOD SPEC.json [KEY=VALUE ...]``; prints what was made as one JSON line.

A specification holds ``run`` and ``args`` (fields of ``RunSpec`` and ``DataArgs``), ``folder`` (of the catalogue) and ``output``;
overrides name a field by its path, as in ``args.cutoff_len=512``, and their values are JSON where they can be.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

from corpusloom.config import DataArgs, RunSpec
from corpusloom.operators.prepare import prepare
from corpusloom.sources.catalog import datasets, read_text


def override(spec: dict, setting: str) -> None:
    """``a.b=value`` into the specification."""
    path, eq, text = setting.partition("=")
    if not eq:
        raise ValueError(f"{setting} is no KEY=VALUE")
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    *parents, last = path.split(".")
    for p in parents:
        spec = spec.setdefault(p, {})
    spec[last] = value


def built(kind: type, values: dict):
    """A dataclass of the values; unknown names are an error, lists become tuples."""
    if unknown := sorted(set(values) - {f.name for f in fields(kind)}):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def run_prepare(spark: SparkSession, spec: dict) -> dict:
    """Encoded splits, written to ``output`` if given; how many rows each has."""
    module = prepare(spark, built(RunSpec, spec.get("run", {})), built(DataArgs, spec.get("args", {})), spec.get("folder", "."))
    counts = {}
    for name, rows in module.splits().items():
        if out := spec.get("output"):
            rows.write.mode("errorifexists").parquet(f"{out.rstrip('/')}/{name}")
            rows = spark.read.parquet(f"{out.rstrip('/')}/{name}")
        counts[name] = rows.count()
    return counts


def run_datasets(spark: SparkSession, spec: dict) -> dict:
    """What the catalogue says of the named datasets."""
    found = datasets(spark, spec.get("args", {}).get("datasets", []), spec.get("folder", "."))
    return {s.name: {"source": s.source, "location": s.location, "formatting": s.formatting, "ranking": s.ranking} for s in found}


METHODS: dict[str, Callable[[SparkSession, dict], dict]] = {"prepare": run_prepare, "datasets": run_datasets}


def main(argv: list[str], spark: SparkSession | None = None) -> dict:
    if len(argv) < 2:
        raise SystemExit(__doc__)
    method, path, *settings = argv
    if method not in METHODS:
        raise NotImplementedError(f"method {method}; there are {', '.join(METHODS)}")
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    spec = json.loads(read_text(spark, path))
    for s in settings:
        override(spec, s)
    return METHODS[method](spark, spec)


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:])))

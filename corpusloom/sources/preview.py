"""Previews of data files: how many rows, and a page of them, in the order of the files.

A large JSON array is not read whole by one task. Its bytes are cut into blocks, and each block is scanned once for each state it
could begin in (inside a string or not, behind a backslash or not): how the depth changes, the state at its end, and where an
element ends at the outermost level. The driver joins the blocks' summaries from left to right (a row per block), which tells the
true state, depth and number of elements before each block; a page is then the bytes between two element ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.catalog import listed

PAGE, BLOCK = 2, 8 << 20
#: States between two bytes: outside of strings, inside of one, behind a backslash there.
OUTSIDE, INSIDE, ESCAPED = range(3)
_STRUCTURE = re.compile(rb"[\[\]{},]").finditer


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Summary:
    """What a block does, if it begins in a state: the state behind it, the change of depth, and for each comma outside of strings the depth there."""

    state: int
    depth: int
    commas: dict[int, int]  #: change of depth -> how many commas there


def marks(data: bytes, state: int) -> Iterator[tuple[int, int]]:
    """(place, byte) of each structural byte outside of strings; the last item is (-1, state at the end)."""
    at, n = 0, len(data)
    while at < n:
        if state == ESCAPED:
            at, state = at + 1, INSIDE
        elif state == INSIDE:
            quote, slash = data.find(b'"', at), data.find(b"\\", at)
            if slash >= 0 and (quote < 0 or slash < quote):
                at, state = slash + 1, ESCAPED
            elif quote >= 0:
                at, state = quote + 1, OUTSIDE
            else:
                at = n
        else:
            quote = data.find(b'"', at)
            stop = n if quote < 0 else quote
            for found in _STRUCTURE(data, at, stop):
                yield found.start(), data[found.start()]
            at = stop
            if quote >= 0:
                at, state = quote + 1, INSIDE
    yield -1, state


def summary(data: bytes, state: int) -> Summary:
    depth, commas = 0, {}
    for at, b in marks(data, state):
        if at < 0:
            return Summary(b, depth, commas)
        if b in b"[{":
            depth += 1
        elif b in b"]}":
            depth -= 1
        else:
            commas[depth] = commas.get(depth, 0) + 1
    return Summary(state, depth, commas)


def blocks(size: int, block: int = BLOCK) -> list[tuple[int, int]]:
    return [(a, min(size, a + block)) for a in range(0, size, block)]


def _read(path: str, start: int, end: int) -> bytes:
    system, at = _system(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(end - start)


def _summaries(spark: SparkSession, path: str, block: int) -> list[tuple[int, int, dict[int, Summary]]]:
    """Of each block, what it does from each state; worked out by tasks."""
    system, at = _system(path)
    spans = blocks(system.get_file_info(at).size, block)
    if not spans:
        return []
    df = spark.createDataFrame(spans, "begin long, stop long").repartition(len(spans), "begin")

    def run(batches):
        for batch in batches:
            out = []
            for begin, stop in zip(batch["begin"], batch["stop"], strict=True):
                data = _read(path, int(begin), int(stop))
                for state in (OUTSIDE, INSIDE, ESCAPED):
                    s = summary(data, state)
                    out.append((begin, stop, state, s.state, s.depth, json.dumps(s.commas)))
            yield pd.DataFrame(out, columns=["begin", "stop", "state", "behind", "depth", "commas"])

    found: dict[tuple[int, int], dict[int, Summary]] = {}
    for r in df.mapInPandas(run, "begin long, stop long, state int, behind int, depth long, commas string").collect():  # three rows a block
        found.setdefault((r["begin"], r["stop"]), {})[r["state"]] = Summary(r["behind"], r["depth"], {int(k): v for k, v in json.loads(r["commas"]).items()})
    return [(a, b, found[a, b]) for a, b in spans]


@dataclass(frozen=True)
class Array:
    """A JSON array in a file: its elements, and where each block stands (begin, stop, state, depth, elements ended before it)."""

    path: str
    count: int
    places: list[tuple[int, int, int, int, int]]


def array(spark: SparkSession, path: str, block: int = BLOCK) -> Array:
    state, depth, commas, places = OUTSIDE, 0, 0, []
    for begin, stop, by_state in _summaries(spark, path, block):
        places.append((begin, stop, state, depth, commas))
        s = by_state[state]
        commas += s.commas.get(1 - depth, 0)
        state, depth = s.state, depth + s.depth
    if state != OUTSIDE or depth:
        raise ValueError(f"{path} ends within an element")
    text = _system(path)[0].get_file_info(_system(path)[1]).size
    head, tail = (_read(path, 0, min(text, 1 << 16)).strip(), _read(path, max(0, text - (1 << 16)), text).strip())
    if not head.startswith(b"[") or not tail.endswith(b"]"):
        raise ValueError(f"{path} is no array")
    empty = commas == 0 and text <= 1 << 16 and not head[1:-1].strip()
    return Array(path, 0 if empty else commas + 1, places)


def elements(found: Array, start: int, end: int) -> list:
    """Elements ``start`` to ``end`` - 1, read from the blocks they lie in."""
    end = min(end, found.count)
    if start >= end:
        return []
    def cut(k: int) -> int:
        """Behind the k-th comma between elements, counted from 1; the array's start for 0."""
        if k == 0:
            return 0
        begin, stop, state, depth, ended = next(p for p, after in zip(found.places, [*(q[4] for q in found.places[1:]), found.count], strict=True) if p[4] < k <= after)
        for at, b in marks(_read(found.path, begin, stop), state):
            depth += (b in b"[{") - (b in b"]}") if at >= 0 else 0
            if at >= 0 and b == 44 and depth == 1:
                ended += 1
                if ended == k:
                    return begin + at + 1
        raise ValueError("the file has changed")

    first = cut(start)
    if end < found.count:
        last = cut(end) - 1
        data = _read(found.path, first, last)
    else:
        system, at = _system(found.path)
        data = _read(found.path, first, system.get_file_info(at).size).rstrip()[:-1]
    return json.loads(b"[" + (data.lstrip()[1:] if start == 0 else data) + b"]")


def preview(spark: SparkSession, path: str, page: int = 0, size: int = PAGE) -> tuple[int, list]:
    """(how many rows, those of a page) of a file or a folder: JSON arrays, JSON lines, or lines of text."""
    total, rows = 0, []
    start, end = page * size, page * size + size
    for f in listed(spark, path):
        lo = total
        if f.endswith(".json"):
            found = array(spark, f)
            total += found.count
            rows += elements(found, max(0, start - lo), max(0, end - lo))
        else:
            lines: DataFrame = spark.read.text(f)
            n = lines.count()
            total += n
            if lo < end and total > start:
                own = lines.offset(max(0, start - lo)).limit(min(end, total) - max(start, lo)).collect()
                rows += [json.loads(r["value"]) if f.endswith(".jsonl") else r["value"] for r in own]
    return total, rows


def turned(page: int, total: int, step: int, size: int = PAGE) -> int:
    """The page before (step -1) or behind (1), if there is one."""
    to = page + step
    return to if to >= 0 and (step < 0 or to * size < total) else page


def page_rows(df: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """A page of numbered rows."""
    return df.filter(F.col("row_idx").between(page * size, page * size + size - 1))

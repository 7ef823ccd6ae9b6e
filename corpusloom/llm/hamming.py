"""All links between 64-bit fingerprints that differ in few bits, by a generalised pigeonhole.

The 64 bits are dealt into parts, correlated bits into the same part, and each part gets a threshold of its own. If the
thresholds t_i of m parts add up to k - m + 1 and two fingerprints differ in at most k bits, then some part differs in at
most t_i bits (-1: the part is never probed). A part with threshold t is probed by its variants with t bits masked: two
values within t bits agree under one of those masks. Which partition and thresholds to use is found by dynamic programming
over estimated rows and candidates; any choice gives the same links, since every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dealt, mixed

#: A bucket of up to so many fingerprints is compared inside one task; larger ones are dealt into pairs of chunks.
CAP = 4096
#: Estimated cost of a probe row, in comparisons.
ROW_COST = 8.0
#: Blocks: comparing so many fingerprints costs about as much as moving one row.
BUCKET = 64


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set, over all rows of ``prints`` (column fp)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["i", "j", "n"]
        )

    rows = prints.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r["i"] == 64:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def _grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each grows from a seed by the bit most correlated with the part so far."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    free, parts = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        seed = min(free, key=lambda b: (abs(p[b] - 0.5), b))
        part = [seed]
        free.discard(seed)
        score = corr[seed].copy()
        while len(part) < width:
            b = max(free, key=lambda x: (round(score[x], 9), -x))
            part.append(b)
            free.discard(b)
            score += corr[b]
        parts.append(sorted(part))
    return parts


def _near(n: int, both: np.ndarray, part: list[int], t: int) -> float:
    """Estimated pairs that differ in at most t bits of the part, from the share of pairs that differ in each bit."""
    p = np.diag(both)[part] / n
    differ = 2 * p * (1 - p)
    dist = np.zeros(t + 1)
    dist[0] = 1.0
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return n * (n - 1) / 2 * float(dist.sum())


def plan(n: int, both: np.ndarray, k: int) -> list[int]:
    """Masks to probe, as unsigned 64-bit integers; the cheapest allocation over 2 to k + 3 parts."""
    if n < 2:
        return []
    best: tuple[float, list[int]] | None = None
    for m in range(2, k + 4):
        parts = _grouped_bits(n, both, m)
        budget = k - m + 1
        # states: sum of thresholds so far -> (cost, thresholds); t = -1 costs nothing
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            price = {-1: 0.0} | {t: ROW_COST * n * comb(len(part), t) + _near(n, both, part, t) for t in range(min(k, 2, len(part)) + 1)}
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, ts) in states.items():
                for t, c in price.items():
                    if s + t not in after or cost + c < after[s + t][0]:
                        after[s + t] = (cost + c, (*ts, t))
            states = after
        if budget not in states:
            continue
        cost, ts = states[budget]
        masks = []
        for part, t in zip(parts, ts, strict=True):
            if t < 0:
                continue
            whole = sum(1 << b for b in part)
            masks += [whole & ~sum(1 << b for b in off) for off in combinations(part, t)]
        if best is None or cost < best[0]:
            best = cost, masks
    return best[1]


def subset_masks(n: int, k: int) -> list[int]:
    """Masks of pigeonhole blocks: of m blocks, any m - k that agree; m grows with log n so that buckets hold ``BUCKET`` or fewer on average."""
    m = k + 1
    while m < k + 6 and n / 2.0 ** (64 * (m - k) / m) > BUCKET:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(m)]
    return [sum(x) for x in combinations(blocks, m - k)]


def _signature(values: np.ndarray, mask: int, salt: int = 0) -> np.ndarray:
    """Names a bucket. Two buckets that share a name only cost comparisons."""
    seed = mixed(np.array([(mask + 0x9E3779B97F4A7C15 * (salt + 1)) % 2**64], dtype=np.uint64))
    return mixed((values & np.uint64(mask)) ^ seed)


def _expander(masks: list[int]) -> Callable:
    def expand(batches):
        for batch in batches:
            ids, fps = batch.column(0), batch.column(1)
            values = fps.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for mask in masks:
                yield pa.RecordBatch.from_arrays([pa.array(_signature(values, mask).view(np.int64)), ids, fps], names=["sig", "id", "fp"])

    return expand


def forest(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one bucket: visits each member once, against those not yet reached."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            close = np.bitwise_count(fps[left] ^ fps[i]) <= k
            if close.any():
                reached = left[close].tolist()
                edges += [(i, j) for j in reached]
                stack += reached
                left = left[~close]
    return edges


def close_pairs(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j that differ in at most k bits; stops early where there are many more than members."""
    left, right, n, found = [], [], len(fps), 0
    for at in range(0, n - 1, 256):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at:]) <= k)
        keep = i < j
        left.append(i[keep] + at)
        right.append(j[keep] + at)
        found += len(left[-1])
        if found > 2 * n:
            break
    return np.concatenate(left), np.concatenate(right)


def stars(a: list, b: list) -> tuple[list, list]:
    """The same components with every member linked to its smallest: what a task knows is joined up before it is written."""
    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    members = [x for x in parent if find(x) != x]
    return [find(x) for x in members], members


def _linker(k: int) -> Callable:
    """Reads rows (sig, id, fp) sorted by sig; a bucket has about CAP rows at most, so few rows wait for the next batch."""

    def link(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            sig = table.column(0).to_numpy()
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            rest = table.slice(last)
            if last:
                yield from work(table.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from work(rest)

    def work(table):
        sig = table.column(0).to_numpy()
        ids = table.column(1).combine_chunks()
        fps = table.column(2).to_numpy().astype(np.int64).view(np.uint64)
        cuts = np.flatnonzero(np.diff(sig)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(sig))
        sizes = ends - starts
        pairs = starts[sizes == 2]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= k]
        left, right = [pairs], [pairs + 1]
        many = sizes > 2
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            i, j = close_pairs(fps[s:e], k)
            if len(i) <= 2 * (e - s):
                left.append(i + s)
                right.append(j + s)
            elif found := forest(fps[s:e], k):
                found = np.array(found, dtype=np.int64) + s
                left.append(found[:, 0])
                right.append(found[:, 1])
        if (a := np.concatenate(left)).size:
            centre, member = stars(ids.take(pa.array(a)).to_pylist(), ids.take(pa.array(np.concatenate(right))).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(centre, type=ids.type), pa.array(member, type=ids.type)], names=["a", "b"])

    return link


def links(nodes: DataFrame, k: int, masks: list[int], cap: int = CAP) -> DataFrame:
    """Links (a, b) that connect what differs in at most k bits; a spanning forest of each bucket rather than all its pairs.

    ``nodes`` has a distinct id and its fingerprint fp (long), distinct too where a group may be large. Buckets are counted
    before they are gathered (partial aggregation takes the hot ones); those of over ``cap`` members are dealt into pairs
    of chunks, so no task holds more than about ``cap`` rows of a bucket and no link is lost. Null fingerprints link to
    nothing.
    """
    id_type = dict(nodes.dtypes)["id"]
    if not masks:
        return nodes.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}")
    rows = nodes.select("id", "fp").filter("fp is not null").mapInArrow(_expander(masks), f"sig long, id {id_type}, fp long")
    ready = dealt(rows.withColumn("w", F.lit(1)), "sig", "w", float(cap)).select("sig", "id", "fp")
    return ready.repartition("sig").sortWithinPartitions("sig").mapInArrow(_linker(k), f"a {id_type}, b {id_type}")

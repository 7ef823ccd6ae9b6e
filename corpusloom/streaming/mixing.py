"""Mixing several streams by seeded turns.

Each source has a queue in keyed state. Turns go round, or are drawn by the same seeded key as ``operators.mix.interleaved``; a
turn whose source has no row yet waits, and so do all later ones, so the mixture is the same whatever arrives first. A source of
which the number of rows is told ends after so many.

``under``: the mixture ends at the first turn that cannot be served (in rounds: at the first round that is not whole).
``over``: an ended source begins again until every source has ended once; so all sources need their numbers of rows, and the rows
of each stay in state, which is bounded by those numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.state import Blocks, lanes, stateful


class Turns(StatefulProcessor):
    def __init__(self, k: int, columns: list[str], order: str, edges: list[float] | None, seed: int, sizes: list[int] | None):
        self.k, self.edges, self.seed, self.sizes = k, edges, seed, sizes
        self.order, self.source = columns.index(order), columns.index("src_idx")
        self.made = Row(*columns, "shard", "place")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "turn long, taken array<long>, come array<long>")
        self.queues = [handle.getMapState(f"queue{i}", "block int", "rows binary") for i in range(self.k)]

    def drawn(self, turn: int) -> int:
        if self.edges is None:
            return turn % self.k
        u = float(int(md5(f"{self.seed}-{turn}".encode()).hexdigest()[:12], 16)) / float(16**12)
        return next((i for i, e in enumerate(self.edges[:-1]) if u < e), self.k - 1)

    def finished(self, turn: int, taken: list[int]) -> bool:
        """Over: has every source been gone through once, and, in rounds, the round with it?"""
        return self.sizes is not None and all(t >= n for t, n in zip(taken, self.sizes, strict=True)) and (self.edges is not None or turn % self.k == 0)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        turn, taken, come = self.at.get() if self.at.exists() else (0, [0] * self.k, [0] * self.k)
        taken, come = list(taken), list(come)
        queues = [Blocks(q) for q in self.queues]
        for row in sorted((tuple(r)[:-1] for r in rows), key=lambda r: (r[self.source], r[self.order])):
            s = row[self.source]
            if self.sizes is None or come[s] < self.sizes[s]:
                queues[s].put(come[s], row)
                come[s] += 1
        while not self.finished(turn, taken):
            if self.edges is None and self.sizes is None and turn % self.k == 0 and any(t >= c for t, c in zip(taken, come, strict=True)):
                break  # no whole round
            s = self.drawn(turn)
            at = taken[s]
            if self.sizes is not None and come[s] == self.sizes[s]:
                at %= self.sizes[s]
            elif at >= come[s]:
                break
            yield self.made(*queues[s][at], key[0], turn)
            taken[s], turn = taken[s] + 1, turn + 1
        if self.sizes is None:
            for q, t in zip(queues, taken, strict=True):
                q.forget(t)
        for q in queues:
            q.write()
        self.at.update((turn, taken, come))

    def close(self) -> None:
        pass


def interleaved(streams: list[DataFrame], order: str, strategy: str = "interleave_under", probabilities: list[float] | None = None, seed: int = 42, sizes: list[int] | None = None, shards: int = 1) -> DataFrame:
    """Rows of all streams (of one schema) with ``src_idx``, ``shard`` and ``place``, their turn in the shard.

    ``order`` sorts a source's rows inside a micro-batch. With several shards, each mixes its own part of every source; ``over``
    takes one shard, as the sizes are those of whole sources.
    """
    if strategy not in ("interleave_under", "interleave_over"):
        raise ValueError(f"unknown strategy {strategy}")
    over = strategy == "interleave_over"
    if over and (sizes is None or len(sizes) != len(streams) or min(sizes) < 1):
        raise ValueError("to begin sources again, the rows of each have to be told, one at least")
    if over and shards > 1:
        raise ValueError("sources begin again in one shard only")
    if probabilities is not None and len(probabilities) != len(streams):
        raise ValueError("one probability per stream")
    stateful(streams[0].sparkSession)
    both = reduce(DataFrame.unionByName, (s.withColumn("src_idx", F.lit(i)) for i, s in enumerate(streams)))
    rows, schema = lanes(both, shards, order)
    edges = list(accumulate(probabilities)) if probabilities is not None else None
    work = Turns(len(streams), both.columns, order, edges, seed, list(sizes) if over else None)
    return rows.groupBy("shard").transformWithState(work, schema, "append", "none")


def concatenated(streams: list[DataFrame]) -> DataFrame:
    """All rows of all streams with ``src_idx``, as they come: streams are not mixed by being put together."""
    return reduce(DataFrame.unionByName, (s.withColumn("src_idx", F.lit(i)) for i, s in enumerate(streams)))

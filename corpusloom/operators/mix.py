"""Mixing, sampling and splitting by position.

Position is an explicit ``row_idx`` from 0, numbered over a natural key in two passes (rows per key range, then offsets), so no
single task sorts everything. "Random" orders are MD5 keys of a seed and the row, the same in any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_key(seed: int | str, *columns: Column | str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


#: Keys drawn per range when ranges are cut, and rows a range should hold at least.
DRAWN, LEAST = 64, 10_000


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many more underscores in front as it takes to be none of those taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def _cuts(keys: DataFrame, ranges: int, rows: int) -> list:
    """Range ends from a bounded sample of the keys (column ``k``). Where they fall changes the balance of the tasks and nothing else."""
    wanted = DRAWN * ranges
    drawn = keys.sample(min(1.0, 1.2 * wanted / rows), 7).limit(4 * wanted) if rows > wanted else keys
    tiles = drawn.select("k", F.ntile(ranges).over(Window.orderBy("k")).alias("t"))
    found = tiles.groupBy("t").agg(F.max("k").alias("end")).orderBy("t").collect()
    return [r["end"] for r in found[:-1]]


def _place(key: Column, kind, cuts: list) -> Column:
    """How many of the ordered cuts lie below the key: every root-th cut first, then those between two of them."""
    def ends(part) -> Column:
        return F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind.fields, strict=True))) for c in part))

    def below(column: Column) -> Column:
        return F.size(F.filter(column, lambda c: c < key))

    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    group = below(ends([g[-1] for g in groups]))
    rest = F.element_at(F.array(*map(ends, groups)), F.least(group + 1, F.lit(len(groups))))
    return F.when(group == len(groups), F.lit(len(cuts))).otherwise(group * step + below(rest))


def numbered(df: DataFrame, *order: Column | str, out: str = "row_idx", hot: bool = False) -> DataFrame:
    """``out``: 0-based place in the given order. Ranges of the keys are ranked on their own and shifted by the counts before them.

    The range of a row is an expression over literal cuts, so the pass that counts and the pass that ranks agree whatever
    was sampled. With ``hot``, for orders that are not unique, a hash of the whole row tells rows of one key apart, so that
    a key of many rows is split as well; without it only the key columns are read for counting.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if hot:
        keys.append(F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant")))
    key, part = fresh("__key", [*df.columns, out]), fresh("__part", [*df.columns, out])
    keyed = df.withColumn(key, F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    rows = keyed.count()
    ranges = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // LEAST))
    cuts = _cuts(keyed.select(F.col(key).alias("k")), ranges, rows) if ranges > 1 else []
    placed = keyed.withColumn(part, _place(F.col(key), keyed.schema[key].dataType, cuts))
    counts = placed.groupBy(part).agg(F.count("*").alias("n")).collect()  # as many rows as ranges
    before, shift = 0, {}
    for r in sorted(counts, key=lambda r: r[part]):
        shift[r[part]], before = before, before + r["n"]
    shifts = F.array(*(F.lit(shift.get(i, 0)).cast("long") for i in range(len(cuts) + 1)))
    local = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    return placed.withColumn(out, (F.element_at(shifts, F.col(part) + 1) + local).cast("long")).drop(part, key)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("row_idx") < n)


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows: a permutation's front, and beyond its end rows drawn again. ``sample_idx`` is the place in the sample."""
    ranked = numbered(df, random_key(seed, "row_idx"), "row_idx", out="sample_idx")
    size = df.count()
    if n <= size or not size:
        return ranked.filter(F.col("sample_idx") < n)
    more = df.sparkSession.range(size, n).select(F.col("id").alias("sample_idx"))
    drawn = more.withColumn("__pick", F.pmod(F.conv(F.substring(random_key(f"{seed}-more", "sample_idx"), 1, 15), 16, 10).cast("long"), F.lit(size)))
    again = drawn.join(df.withColumn("__pick", F.col("row_idx")), "__pick").drop("__pick")
    return ranked.unionByName(again.select(ranked.columns))


def concatenated(*tables: DataFrame) -> DataFrame:
    """UNION ALL in order: src_idx, then each table's row_idx."""
    return reduce(DataFrame.unionByName, (t.withColumn("src_idx", F.lit(i)) for i, t in enumerate(tables)))


def interleaved(tables: list[DataFrame], strategy: str = "interleave_under", probabilities: list[float] | None = None, seed: int = 42) -> DataFrame:
    """Rows taken in turn: until the first table ends (under), or with shorter ones repeated until all have ended (over).

    With probabilities, each place draws its table by a seeded key; the place is then the draw's rank within its table.
    ``mix_idx`` orders the result.
    """
    if len(tables) == 1:
        return tables[0].withColumn("src_idx", F.lit(0)).withColumn("mix_idx", F.col("row_idx"))
    sizes = [t.count() for t in tables]
    k = len(tables)
    if min(sizes) == 0:
        raise ValueError("an empty table cannot be interleaved")
    if probabilities is None:
        rounds = min(sizes) if strategy == "interleave_under" else max(sizes)
        parts = []
        for i, (t, n) in enumerate(zip(tables, sizes, strict=True)):
            places = tables[0].sparkSession.range(rounds).select(F.col("id").alias("__round"), (F.col("id") % n).alias("row_idx"))
            parts.append(places.join(t, "row_idx").withColumn("src_idx", F.lit(i)).withColumn("mix_idx", F.col("__round") * k + i).drop("__round"))
        return reduce(DataFrame.unionByName, parts)
    total = sum(sizes) * 4 + 64 if strategy == "interleave_over" else sum(sizes)
    edges = [sum(probabilities[: i + 1]) for i in range(k)]
    u = F.conv(F.substring(random_key(seed, "id"), 1, 12), 16, 10).cast("double") / float(16**12)
    source = reduce(lambda c, i: c.when(u < edges[i], i), range(1, k - 1), F.when(u < edges[0], 0)).otherwise(k - 1)
    draws = tables[0].sparkSession.range(total).select(F.col("id").alias("mix_idx"), source.alias("src_idx"))
    draws = ranked_by_stretch(draws, "src_idx", "mix_idx", "__take")
    limits = F.element_at(F.array(*(F.lit(n) for n in sizes)), F.col("src_idx") + 1)
    if strategy == "interleave_under":  # the first draw that finds its table empty ends it
        end = draws.filter(F.col("__take") >= limits).agg(F.min("mix_idx").alias("e")).first()["e"]
        draws = draws if end is None else draws.filter(F.col("mix_idx") < end)
    else:  # ends when every table has been gone through once
        done = draws.filter(F.col("__take") == limits - 1).agg(F.max("mix_idx").alias("e"), F.count("*").alias("n")).first()
        if done["n"] == k:
            draws = draws.filter(F.col("mix_idx") <= done["e"])
    wanted = draws.withColumn("row_idx", F.col("__take") % limits).drop("__take")
    return wanted.join(concatenated(*tables), ["src_idx", "row_idx"])


#: Places of a mixture that one task ranks.
STRETCH = 65_536


def ranked_by_stretch(df: DataFrame, key: str, place: str, out: str) -> DataFrame:
    """``out``: how many rows of the key come before, for dense places: ranks inside stretches of them, onto the stretches' counts."""
    cut = df.withColumn("__b", F.floor(F.col(place) / STRETCH).cast("long"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(key, "__b").agg(F.count("*").alias("__n")).select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    rank = F.row_number().over(Window.partitionBy(key, "__b").orderBy(place)) - 1
    return cut.join(ahead, [key, "__b"]).withColumn(out, F.col("__ahead") + rank).drop("__b", "__ahead")


def split(df: DataFrame, val_size: float, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """A column ``split``: exactly val_size rows (or that share, rounded up) of a seeded order are validation, the rest train."""
    n = df.count()
    take = int(val_size) if val_size >= 1 else -(-int(n * val_size * 10**9) // 10**9)
    ranked = numbered(df, random_key(seed, "row_idx"), "row_idx", out="__rank") if shuffle else df.withColumn("__rank", F.col("row_idx"))
    return ranked.withColumn("split", F.when(F.col("__rank") < take, "validation").otherwise("train")).drop("__rank")


def head_split(df: DataFrame, n: float) -> tuple[DataFrame, DataFrame]:
    """(all rows, the first n of them): the head serves for evaluation and stays in training."""
    return df, df.filter(F.col("row_idx") < max(0, int(n)))


def shuffled(df: DataFrame, seed: int, disable: bool = False) -> DataFrame:
    """A global order: seeded, or by row_idx if disabled."""
    return df.orderBy("row_idx") if disable else df.orderBy(random_key(seed, "row_idx"))

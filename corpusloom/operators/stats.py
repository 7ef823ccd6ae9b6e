"""Statistics over lengths, labels, losses and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import valid_labels
from corpusloom.operators.mix import numbered


def length_cdf(df: DataFrame, length: Column, interval: int) -> DataFrame:
    """bucket, upper_bound, n, running_n, running_pct: the histogram of lengths and its running share."""
    # the buckets are few: one row per interval of lengths
    counts = df.select((F.floor(length / interval) * interval).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = F.sum("n").over(w)
    return counts.select("bucket", (F.col("bucket") + interval).alias("upper_bound"), "n", running.alias("running_n"), (running * 100.0 / F.sum("n").over(whole)).alias("running_pct"))


def valid_ratio(df: DataFrame, labels: str = "labels", batch: str = "batch_id") -> DataFrame:
    """Labels that count over all places, the padding of each batch to its longest row included."""
    per = df.groupBy(batch).agg(F.sum(F.size(valid_labels(F.col(labels)))).alias("valid"), (F.max(F.size(labels)) * F.count("*")).alias("places"))
    return per.agg(F.sum("valid").alias("valid"), F.sum("places").alias("places")).withColumn("ratio", F.col("valid") / F.col("places"))


#: The rate at the reference batch of tokens.
BASE_RATE, BASE_TOKENS = 3e-4, 4_000_000


def optimal_rate(cutoff: int, batch: int, ratio: Column | float, small: bool = False) -> Column:
    """A learning rate by the square root of the tokens of a step; a sixth of it for the model families that need less."""
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    rate = BASE_RATE * F.sqrt(ratio * float(cutoff * batch) / BASE_TOKENS)
    return rate / 6 if small else rate


def throughput(df: DataFrame, ids: str, epochs: float, seconds: float, world: int = 1) -> DataFrame:
    """Tokens a second and device."""
    return df.agg((F.sum(F.size(ids)) * epochs / seconds / world).alias("tokens_per_second"))


def smoothing_weight(n: Column) -> Column:
    return 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)


def stretched(df: DataFrame, order: str, key: str | None, stretch: int) -> DataFrame:
    """The rows with __key (the key, or a constant) and __b: consecutive rows of a key, at most ``stretch`` of them.

    Rows are numbered over key and order by ranges, so a long series is ordered by many tasks.
    """
    keyed = df.withColumn("__key", F.col(key) if key else F.lit(0))
    placed = numbered(keyed.withColumn("__series", F.col("__key")), "__series", order, out="__k")
    return placed.withColumn("__b", F.floor(F.col("__k") / stretch).cast("long")).drop("__k", "__series")


def smoothed(df: DataFrame, key: str, order: str, value: str, stretch: int = 1024) -> DataFrame:
    """Per key, the exponentially smoothed series as rows (key, order, value, smoothed); the weight follows the series' length.

    A series is cut into stretches. Each is folded from zero, which tells what it adds and by how much it fades what came
    before; a fold over those few numbers a key gives the value that each stretch starts from. No task holds more than a
    stretch, and per key the numbers of its stretches; the joins are on key and stretch, so no key is large in them.
    """
    item = F.struct(F.col(order), F.col(value), F.col(value).cast("double").alias("__x"))
    placed = stretched(df.select(key, order, value), order, key, stretch)
    cut = placed.groupBy("__key", "__b").agg(F.array_sort(F.collect_list(item)).alias("__s"))
    sizes = placed.groupBy("__key", "__b").agg(F.count("*").alias("n")).groupBy("__key").agg(F.sum("n").alias("n"), F.collect_list("__b").alias("b"))
    lengths = sizes.select(F.col("__key").alias("__of"), smoothing_weight(F.col("n").cast("double")).alias("__w"), F.explode("b").alias("__at"))
    cut = cut.join(lengths, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__b") == F.col("__at"))).drop("__of", "__at")
    weight = F.col("__w")
    onward = lambda last, x: last * weight + (1 - weight) * x["__x"]
    told = cut.select("__key", F.struct("__b", F.aggregate("__s", F.lit(0.0), onward).alias("adds"), F.pow("__w", F.size("__s")).alias("fades"), F.col("__s")[0]["__x"].alias("first")).alias("__t"))
    chain = told.groupBy("__key").agg(F.array_sort(F.collect_list("__t")).alias("__c"))
    none = F.expr("cast(array() as array<double>)")
    starts = F.aggregate("__c", F.struct(F.col("__c")[0]["first"].alias("last"), none.alias("out")), lambda a, t: F.struct((a["last"] * t["fades"] + t["adds"]).alias("last"), F.concat(a["out"], F.array(a["last"])).alias("out")))
    begun = chain.select(F.col("__key").alias("__of"), F.explode(F.arrays_zip(F.col("__c.__b").alias("at"), starts["out"].alias("start"))).alias("__z")).select("__of", F.col("__z.at").alias("__at"), F.col("__z.start").alias("__start"))
    joined = cut.join(begun, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__b") == F.col("__at")))
    fold = F.aggregate("__s", F.struct(F.col("__start").alias("last"), none.alias("out")), lambda a, x: F.struct(onward(a["last"], x).alias("last"), F.concat(a["out"], F.array(onward(a["last"], x))).alias("out")))
    rows = joined.select(F.col("__key").alias(key), F.explode(F.arrays_zip(F.col("__s").alias("s"), fold["out"].alias("o"))).alias("__z"))
    return rows.select(key, F.col(f"__z.s.{order}").alias(order), F.col(f"__z.s.{value}").alias(value), F.col("__z.o").alias("smoothed"))


def loss_rows(df: DataFrame, loss: str = "loss") -> DataFrame:
    """Log rows with a loss; zero and null are left out."""
    return df.filter(F.col(loss).isNotNull() & (F.col(loss) != 0) & ~F.isnan(loss))


def duration(seconds: Column) -> Column:
    """h:mm:ss, with days in front from one day on."""
    s = seconds.cast("long")
    days = F.floor(s / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")), clock))


def progress(df: DataFrame, done: str, total: str, elapsed: str) -> DataFrame:
    """percentage, elapsed_time, remaining_time per log row, by the mean time of a step."""
    left = F.when(F.col(done) > 0, F.col(elapsed) / F.col(done) * (F.col(total) - F.col(done))).otherwise(F.lit(0.0))
    return df.withColumns({
        "percentage": F.when(F.col(total) > 0, F.round(F.col(done) / F.col(total) * 100, 2)).otherwise(F.lit(100.0)), "elapsed_time": duration(F.col(elapsed)), "remaining_time": duration(left),
    })


def running(df: DataFrame, order: str, value: str, key: str | None = None, stretch: int = 65_536) -> DataFrame:
    """Sum, count and average so far: inside stretches, onto the sums of the stretches before."""
    placed = stretched(df, order, key, stretch)
    parts = placed.groupBy("__key", "__b").agg(F.sum(value).alias("__sum"), F.count(value).alias("__count"))  # a row per stretch
    before = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col("__key").alias("__of"), F.col("__b").alias("__at"), F.sum("__sum").over(before).alias("__s"), F.sum("__count").over(before).alias("__n"))
    both = placed.join(ahead, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__b") == F.col("__at")))
    here = Window.partitionBy("__key", "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(value).over(here)
    total = F.when(own.isNull(), F.col("__s")).otherwise(own + F.coalesce(F.col("__s"), F.lit(0)))
    count = F.count(value).over(here) + F.coalesce(F.col("__n"), F.lit(0))
    out = both.withColumns({"sum": total, "count": count}).withColumn("avg", F.col("sum") / F.col("count"))
    return out.select(*df.columns, "sum", "count", "avg")


def schedule(rows: int, per_step: int, accumulate: int, epochs: int, done: int = 0) -> dict[str, int]:
    """Steps per epoch and in all, and where a resumed run starts."""
    batches = math.ceil(rows / per_step)
    steps = max(1, math.ceil(batches / accumulate))
    return {"steps_per_epoch": steps, "total_steps": steps * epochs, "first_epoch": done // steps, "skip_batches": done % steps * accumulate}


def transformer_flops(
    layers: int, hidden: int, inner: int, vocab: int, length: Column, kv_share: float = 1.0, batch: int = 1,
    tied: bool = False, backward: bool = True, recompute: bool = False, flash: bool = False,
) -> Column:
    """Floating-point operations of a pass over ``batch`` sequences of ``length`` tokens.

    A multiply-add counts 2. Blocks (gated layers, projections, the two products of attention) count once more for each further
    pass: two for backward, one for recomputation; embeddings, twice unless tied, have no recomputation.
    """
    n = length.cast("double")
    tokens = n * float(batch)
    dense = tokens * float(layers * 6 * hidden * inner)
    projected = tokens * float(layers * 4 * hidden * hidden * (1 + kv_share))
    products = n * n * float(batch * layers * 4 * hidden)
    embedded = tokens * float(hidden * vocab * (1 if tied else 2))
    passes = 3 if backward else 1
    total = (dense + projected + products) * (passes + int(recompute)) + embedded * passes
    return total + products if flash else total


def utilisation(flops: Column, seconds: Column, device_tflops: float, world: int = 1) -> Column:
    return flops / seconds / (device_tflops * 1e12 * world)


def mean_embedding(tokens: DataFrame, vectors: DataFrame, key: str, ids: str, vector_id: str, vector: str) -> DataFrame:
    """Per key, the mean of the vectors of its token ids (unknown ids left out). Vectors are joined whole and taken apart only for the sums."""
    each = tokens.select(key, F.explode(ids).alias(vector_id)).groupBy(key, vector_id).agg(F.count("*").alias("__times"))
    placed = each.join(vectors.select(vector_id, F.col(vector).alias("__vector")), vector_id).select(key, "__times", F.posexplode("__vector").alias("__i", "__v"))
    means = placed.groupBy(key, "__i").agg((F.sum(F.col("__v") * F.col("__times")) / F.sum("__times")).alias("__m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias("embedding"))


def described_embedding(tokens: DataFrame, descriptions: DataFrame, vectors: DataFrame, tok, token: str = "token", description: str = "description", vector_id: str = "token_id", vector: str = "embedding") -> DataFrame:
    """New tokens with the mean vector of the words that describe them; a token without a description, or with unknown words only, has none."""
    told = tokens.join(descriptions.select(token, tok(F.col(description)).alias("__ids")), token, "left")
    means = mean_embedding(told.filter("__ids is not null"), vectors, token, "__ids", vector_id, vector)
    return tokens.join(means, token, "left")


def noisy_mean(vectors: DataFrame, vector: str, seed: int = 0) -> DataFrame:
    """The mean of all vectors plus normal noise of deviation 1 / sqrt(dimension)."""
    means = vectors.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    n = F.count("*").over(Window.partitionBy())  # as many rows as dimensions
    return means.select("i", (F.col("m") + F.randn(seed) / F.sqrt(n)).alias("v"))

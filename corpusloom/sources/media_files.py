"""Which media exist: a listing of a folder, joined to the paths that rows name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A path that many rows name is looked up under so many keys.
SALTS = 16


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """relative and path of all files under a folder; large folders are listed by tasks, and no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return files.select(F.expr(f"substring(path, {len(root) + 1})").alias("relative"), "path")


def resolved(df: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """The rows with every path of the array columns that exists under ``folder`` replaced by its place there; others stay.

    Each distinct path is looked up once. The answers go back to the paths under ``SALTS`` keys each, so a path that a third of all
    rows share is no single task, and lists keep their order. Absolute paths and locations with a scheme are never looked up. A
    folder that is not there resolves nothing.
    """
    spark = df.sparkSession
    try:
        files = listing(spark, folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e):
            return df
        raise
    keyed = df.withColumn("__row", F.monotonically_increasing_id()) if "row_idx" not in df.columns else df.withColumn("__row", F.col("row_idx"))

    def placed(k: int, c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda p, i: F.struct(F.lit(k).alias("column"), i.alias("place"), p.alias("named")))

    def answered(k: int, c: str) -> Column:
        paths = F.transform(F.filter("__m", lambda m: m["column"] == k), lambda m: m["path"])
        return F.when(F.col(c).isNotNull() & F.col("__m").isNotNull(), paths).otherwise(F.col(c))

    each = [placed(k, c) for k, c in enumerate(columns)]
    named = keyed.select("__row", F.explode(F.concat(*each)).alias("m")).select("__row", "m.*")
    own = F.col("named").isNotNull() & ~F.col("named").startswith("/") & ~F.col("named").contains("://")
    wanted = named.filter(own).select("named").distinct()
    tidy = F.regexp_replace(F.col("named"), r"^(\./)+", "")
    root = F.lit(folder.rstrip("/") + "/")
    found = wanted.join(files, tidy == F.col("relative"), "left_semi").select("named", F.concat(root, "named").alias("found"))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = named.withColumn("salt", F.pmod(F.xxhash64("__row", "column", "place"), F.lit(SALTS)).cast("int")).join(salted, ["named", "salt"], "left")
    lists = told.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("column", "place", F.coalesce("found", "named").alias("path")))).alias("__m"))
    joined = keyed.join(lists, "__row", "left")
    return joined.withColumns({c: answered(k, c) for k, c in enumerate(columns)}).select(*df.columns)

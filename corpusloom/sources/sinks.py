"""Writers."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import rotated


def save(df: DataFrame, path: str, by_split: bool = False) -> None:
    """Processed or encoded rows as Parquet, a folder per split on demand; an existing path is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy("split") if by_split else writer).parquet(path)


def save_predictions(df: DataFrame, path: str) -> None:
    """prompt, predict, label as JSON lines; text stays as it is."""
    df.select("prompt", "predict", "label").write.mode("errorifexists").json(path)


def tidy_predictions(df: DataFrame, ids: str, pad: int) -> DataFrame:
    """Leading pads moved behind the tokens."""
    return df.withColumn(ids, rotated(F.col(ids), pad))


def save_metrics(df: DataFrame, path: str) -> None:
    """One JSON object with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def save_scores(df: DataFrame, path: str, category: str = "category", score: str = "accuracy") -> None:
    """A text log of a score per category, right-aligned, one to a line."""
    width = F.max(F.length(category)).over(Window.partitionBy())  # a row per category
    line = F.concat(F.lpad(F.col(category), F.col("__w").cast("int"), " "), F.lit(": "), F.format_string("%.2f", F.col(score).cast("double")))
    df.withColumn("__w", width).orderBy(category).select(line.alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def save_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def save_drawings(df: DataFrame, path: str, name: str = "name", svg: str = "svg_text") -> None:
    """A folder per name with the markup as text, by Spark's writer, so any store works."""
    df.filter(F.col(svg).isNotNull()).select(F.col(name).alias("name"), F.col(svg).alias("value")).write.mode("errorifexists").partitionBy("name").text(path)


def pretty(svg: Column, indent: int = 2) -> Column:
    """Markup with an element a line, indented by depth; text that cannot be parsed stays as it is."""

    @F.pandas_udf("string")
    def laid_out(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _laid_out(t, indent), na_action="ignore")

    return laid_out(svg)


def _laid_out(text: str, indent: int) -> str:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return text
    for prefix, uri in re.findall(r'xmlns:?(\w*)="([^"]*)"', text):
        ElementTree.register_namespace(prefix, uri)
    ElementTree.indent(root, " " * indent)
    return ElementTree.tostring(root, encoding="unicode")


def drawable(df: DataFrame, svg: str = "svg_code") -> DataFrame:
    """Rows with markup that can be a drawing."""
    return df.filter(F.col(svg).isNotNull() & F.col(svg).contains("<svg"))

"""Queries over drawings (made from integer columns, as the tables hold none), media text and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import media, svg, tools
from corpusloom.functions.tokens import refilled, with_placeholders
from corpusloom.plans.catalogue import query, table


def s(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def colour(n: Column) -> Column:
    return F.format_string("#%06x", (n * 7919 % 16777216).cast("int"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing per part: a gradient, a group, a path of the part's numbers, a shape and a caption."""
    k, z = F.col("p_partkey"), F.col("p_size")
    markup = s(
        '<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink"><linearGradient id="a"><stop offset="0" stop-color="', colour(k), '"/></linearGradient>',
        '<g fill="', colour(k + 1), '" stroke-width="2.50"><circle cx="', z, '" cy="', k % 100, '.257" r="3"/><path d="m', k % 128, " ", z, " l", z, ",", k % 7, '.5 z" fill="url(#a)"/></g>',
        '<path d="M1 1 h', z, ' v3"/><rect width="', z, '" height="4" x="1"/><text x="', k % 9, '" y="2">part</text></svg>',
    )
    # the parts of many drawings fill one file block: they are dealt out while they are narrow, as the markup is walked in Python
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(tasks, "p_partkey")
    return parts.select("p_partkey", F.col("p_name").alias("blip_caption"), markup.alias("svg_code"))


@query()
def svg_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg.prepare(drawings(spark, sf_dir), debug=True).select("p_partkey", "svg_text", "struct_svg", "error")


@query()
def svg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = svg.prepare(drawings(spark, sf_dir))
    return rows.select("p_partkey", svg.decode_column(F.col("svg_text")).alias("svg"))


@query("""SELECT p_partkey, list_transform(regexp_extract_all('m' || p_partkey || ' ' || p_size || ' l' || p_size || ',-' || (p_partkey % 7) || '.5 z', '[a-zA-Z]\\s*[-0-9.,\\s]*'), lambda x: left(x, 1) || ':' || array_to_string(regexp_extract_all(substr(x, 2), '[-+]?\\d*\\.?\\d+'), '/')) AS commands FROM part""")
def path_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s("m", F.col("p_partkey"), " ", F.col("p_size"), " l", F.col("p_size"), ",-", F.col("p_partkey") % 7, ".5 z")
    found = F.transform(svg.path_commands(d), lambda x: F.concat(x["command"], F.lit(":"), F.array_join(x["numbers"], "/")))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("commands"))


@query("""SELECT p_partkey, (p_partkey * 7919 % 16777216) // 65536 AS r, (p_partkey * 7919 % 16777216) // 256 % 256 AS g, p_partkey * 7919 % 256 AS b FROM part""")
def hex_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = svg.rgb(colour(F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", c["r"].cast("long").alias("r"), c["g"].cast("long").alias("g"), c["b"].cast("long").alias("b"))


@query("""WITH c AS (SELECT l_orderkey, (l_partkey * 7919 % 16777216)::BIGINT AS v FROM lineitem)
SELECT l_orderkey, format('#{:02x}{:02x}{:02x}', sum(v // 65536)::BIGINT // count(*), sum(v // 256 % 256)::BIGINT // count(*), sum(v % 256)::BIGINT // count(*)) AS colour FROM c GROUP BY 1""")
def avg_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(colour(F.col("l_partkey"))).alias("c"))
    return rows.select("l_orderkey", svg.mean_colour(F.col("c")).alias("colour"))


@query("""SELECT p_partkey, 'size [<|COORD|>] [<|cx|>] [<|COORD|>] fill [<|COLOR|>]' AS marked, [p_size::VARCHAR, (p_partkey % 50) || '.25'] AS numbers, ['#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')] AS colours,
'size ' || p_size || '.00 [<|cx|>] ' || (p_partkey % 50) || '.25 fill [<|COLOR|>]' AS refilled FROM (SELECT p_partkey, p_size FROM part) """.replace("to_hex(p_partkey * 7919 % 16777216)", "lower(to_hex((p_partkey * 7919 % 16777216)::BIGINT))"))
def number_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = s("size ", F.col("p_size"), " [<|cx|>]", F.col("p_partkey") % 50, ".25 fill", colour(F.col("p_partkey")))
    marked, numbers, colours = with_placeholders(text, colours=True)
    rows = table(spark, sf_dir, "part").select("p_partkey", marked.alias("marked"), numbers.alias("numbers"), colours.alias("colours"))
    return rows.withColumn("refilled", refilled(F.col("marked"), F.transform("numbers", lambda x: x.cast("double"))))


@query("""SELECT p_partkey, md5('Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10)
|| 'Generate an SVG illustration from the given description.' || chr(10) || chr(10) || '### Input:' || chr(10) || 'SVG illustration of ' || p_name || chr(10) || chr(10) || '### Response:') AS alpaca, md5(p_name || '. output:') AS caption, md5('Instruct: ' || p_name || chr(10) || 'Output: ') AS instruct FROM part""")
def drawing_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *(F.md5(svg.drawing_prompt(k, F.col("p_name"))).alias(k) for k in ("alpaca", "caption", "instruct")))


@query("""SELECT p_partkey, 'M1' || repeat('x', p_size) || '[<|END_OF_SVG|>]' AS kept FROM part""")
def trim_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("M1"), F.repeat(F.lit("x"), F.col("p_size")), F.lit("[<|END_OF_SVG|>] and more"))
    return table(spark, sf_dir, "part").select("p_partkey", svg.trimmed(text).alias("kept"))


@query("""SELECT p_partkey, 'See <|vision_start|>' || repeat('<|image_pad|>', (p_size * 4 // 4)::INT) || '<|vision_end|> and <|vision_start|>' || repeat('<|image_pad|>', ((p_partkey % 5 + 1) * 4 // 4)::INT) || '<|vision_end|>.' AS content,
 (p_size // 14) * (p_partkey % 100 // 14) + 0 AS n_patches, floor((floor((p_partkey - 1) / 2) - 1) / 2)::BIGINT + 1 AS n_audio FROM part""")
def media_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit("See <image> and <image>.").alias("content")))
    one, four = F.lit(1), F.lit(4)
    counts = F.array(media.merged_grid(one, F.col("p_size"), four, 2), media.merged_grid(one, (F.col("p_partkey") % 5 + 1), four, 2))
    out = media.process(messages, "qwen2_vl", image=counts)
    return table(spark, sf_dir, "part").select(
        "p_partkey", out[0]["content"].alias("content"), media.patches(F.col("p_size"), F.col("p_partkey") % 100, 14).cast("long").alias("n_patches"),
        media.audio_tokens(F.col("p_partkey")).cast("long").alias("n_audio"),
    )


@query("""SELECT p_partkey, CASE WHEN w * h > 20000 THEN trunc(w * sqrt(20000.0 / (w * h)))::INT WHEN w * h < 400 THEN trunc(w * sqrt(400.0 / (w * h)))::INT ELSE w END AS width,
CASE WHEN w * h > 20000 THEN trunc(h * sqrt(20000.0 / (w * h)))::INT WHEN w * h < 400 THEN trunc(h * sqrt(400.0 / (w * h)))::INT ELSE h END AS height FROM (SELECT p_partkey, (p_partkey % 997 + 1)::INT AS w, p_size AS h FROM part)""")
def image_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = media.resized(F.col("p_partkey") % 997 + 1, F.col("p_size"), 20000, 400)
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("""SELECT p_partkey, CASE WHEN n > 0 THEN [CASE WHEN n > 1 THEN trunc(i * ((p_size * 10 - 1)::DOUBLE / (n - 1)))::INT ELSE 0 END FOR i IN range(n)] ELSE []::INT[] END AS frames FROM (SELECT p_partkey, p_size, least(p_size * 10, 8, floor(p_partkey % 7 * 2.0)::INT)::INT AS n FROM part)""")
def frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", media.frame_indices(F.col("p_size") * 10, (F.col("p_partkey") % 7).cast("double"), 2.0, 8).alias("frames"))


@query()
def tool_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool per nation, its prompt, a call and the call found again, in every format."""
    n = table(spark, sf_dir, "nation")
    tool = s('[{"name": "visit_', F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")), '", "description": "Visit.", "parameters": {"type": "object", "properties": {"days": {"type": "integer", "description": "How long"}}, "required": ["days"]}}]')
    call = s('{"name": "visit", "arguments": {"days": ', F.col("n_nationkey"), "}}")
    out = n.select("n_nationkey", tool.alias("tools"), call.alias("call"))
    for f in ("default", "glm4", "mistral", "qwen", "llama3"):
        text = tools.call_text_column(F.col("call"), f)
        out = out.withColumns({f"{f}_call": text}).withColumn(f"{f}_found", tools.calls_column(F.col(f"{f}_call"), f))
        if f != "llama3":  # its prompt holds the date
            out = out.withColumn(f"{f}_prompt", F.md5(tools.tool_prompt_column(F.col("tools"), f)))
    return out.drop("tools", "call")

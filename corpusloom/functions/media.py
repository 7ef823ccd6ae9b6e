"""Media in text: geometry of images and videos, counts of their tokens, and the expansion of placeholders; all native columns.

Counts are columns (array<int>, one per medium of the row, in order), so nothing here decodes media.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a medium in a text.
PLACEHOLDERS = {"image": "<image>", "video": "<video>", "audio": "<audio>"}


def div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


# --- geometry -----------------------------------------------------------------------------------------------------


def resized(width: Column, height: Column, most: int, least: int) -> Column:
    """struct<width, height> after shrinking to ``most`` pixels, then growing to ``least``."""

    def scaled(size: Column, bound: int, test) -> Column:
        area = size["w"] * size["h"]
        by = F.sqrt(F.lit(float(bound)) / area)
        return F.when(test(area), F.struct((size["w"] * by).cast("int").alias("w"), (size["h"] * by).cast("int").alias("h"))).otherwise(size)

    size = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))
    out = scaled(scaled(size, most, lambda a: a > most), least, lambda a: a < least)
    return F.struct(out["w"].alias("width"), out["h"].alias("height"))


def bounded_aspect(width: Column, height: Column, side: int = 28, ratio: int = 200, to: int = 180) -> Column:
    """struct<width, height> with sides of ``side`` at least and no side over ``ratio`` times the other."""
    w, h = F.greatest(width, F.lit(side)), F.greatest(height, F.lit(side))
    w2 = F.when(w / h > ratio, h * to).otherwise(w)
    return F.struct(w2.alias("width"), F.when(h / w2 > ratio, w2 * to).otherwise(h).alias("height"))


def frame_indices(total: Column, seconds: Column, fps: float, most: int) -> Column:
    """Evenly spread frames of a video, first and last included; ``most`` of them where the length is unknown (0)."""
    n = F.when(total == 0, F.lit(most)).otherwise(F.least(total, F.lit(most), F.floor(seconds * fps))).cast("int")
    last = F.when(total == 0, F.lit(most)).otherwise(total) - 1
    at = lambda i: F.when(n > 1, i * (last / (n - 1))).otherwise(F.lit(0.0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.expr("cast(array() as array<int>)"))


# --- token counts -------------------------------------------------------------------------------------------------


def patches(height: Column, width: Column, patch: int, extra: int = 0, drop_first: bool = False) -> Column:
    return div(height, patch) * div(width, patch) + extra - int(drop_first)


def pooled_frames(height: Column, width: Column, patch: int, frames: Column) -> Column:
    return div(patches(height, width, patch), 4) * frames


def merged_grid(t: Column, h: Column, w: Column, merge: int) -> Column:
    return div(t * h * w, merge * merge)


def audio_tokens(frames: Column) -> Column:
    return div(div(frames - 1, 2) + 1 - 2, 2) + 1


def grid_text(height: Column, width: Column, patch: int, token: str, line_end: str, end: str) -> Column:
    """Rows of image tokens, each closed by ``line_end``, the last by ``end``."""
    row = F.concat(F.repeat(F.lit(token), div(width, patch)), F.lit(line_end))
    n = div(height, patch)
    body = F.repeat(row, n)
    return F.concat(F.substring(body, F.lit(1), F.length(body) - len(line_end)), F.lit(end))


# --- placeholders -------------------------------------------------------------------------------------------------


def expanded(text: Column, kind: str, pieces: Column, start: Column | None = None) -> Column:
    """Each placeholder replaced by its piece (array<string>, the row's media in order); too few pieces raise."""
    parts = F.split(text, PLACEHOLDERS[kind], -1)
    first = F.lit(0) if start is None else start
    missing = F.raise_error(F.lit(f"fewer {kind}s than placeholders")).cast("string")
    piece = lambda i: F.coalesce(F.get(pieces, first + i - 1), missing)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(piece(i), p))), "")


def placeholder_count(text: Column, kind: str) -> Column:
    return F.size(F.split(text, PLACEHOLDERS[kind], -1)) - 1


def expanded_messages(messages: Column, kind: str, pieces: Column) -> Column:
    """Messages with their placeholders expanded, media counted on from message to message; the number of media has to fit."""
    before = lambda i: F.aggregate(F.slice(messages, F.lit(1), i), F.lit(0), lambda a, m: a + placeholder_count(m["content"], kind))
    out = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), expanded(m["content"], kind, pieces, before(i)).alias("content")))
    total = F.aggregate(messages, F.lit(0), lambda a, m: a + placeholder_count(m["content"], kind))
    fits = total == F.coalesce(F.size(pieces), F.lit(0))
    return F.when(fits, out).otherwise(F.raise_error(F.lit(f"the number of {kind}s does not match the placeholders")).cast("array<struct<role:string,content:string>>"))


Pieces = Callable[[Column], Column]  #: token counts -> texts
_PLUGINS: dict[str, dict[str, Pieces]] = {}


def register_plugin(name: str, **kinds: Pieces) -> None:
    """How a model writes each kind of medium, given the counts; kinds that are not named are not supported."""
    if name in _PLUGINS:
        raise ValueError(f"media plugin {name} exists")
    _PLUGINS[name] = kinds


def plugin(name: str) -> dict[str, Pieces]:
    if name not in _PLUGINS:
        raise ValueError(f"media plugin {name} does not exist")
    return _PLUGINS[name]


def check_support(name: str, kinds: set[str]) -> None:
    if missing := kinds - plugin(name).keys():
        raise ValueError(f"{name} takes no {', '.join(sorted(missing))}")


def repeated(token: str, before: str = "", after: str = "") -> Pieces:
    return lambda counts: F.transform(counts, lambda n: F.concat(F.lit(before), F.repeat(F.lit(token), n.cast("int")), F.lit(after)))


def once(token: str) -> Pieces:
    return lambda counts: F.transform(counts, lambda n: F.lit(token))


def crops(token: str) -> Pieces:
    """An image, and its crops where there are any (the counts)."""
    told = lambda n: F.concat(F.lit(f"Here is the original image {token} and here are some crops to help you see better "), F.array_join(F.array_repeat(F.lit(token), n), " "))
    return lambda counts: F.transform(counts, lambda n: F.when(n > 0, told(n)).otherwise(F.lit(token)))


def lined(token: str, line_end: str, end: str) -> Pieces:
    """Rows of tokens, each closed by ``line_end``, the last by ``end``; a count is struct<rows, columns>."""

    def one(n: Column) -> Column:
        row = F.repeat(F.lit(token), n["columns"].cast("int"))
        return F.concat(F.array_join(F.array_repeat(row, n["rows"].cast("int")), line_end), F.lit(end))

    return lambda counts: F.transform(counts, one)


def tiled(patch: str, whole: str, start: str, end: str, beside: str, below: str) -> Pieces:
    """Tiles in rows where there are several, then the whole image; a count is struct<rows, columns, patches>."""

    def one(n: Column) -> Column:
        tile = F.repeat(F.lit(patch), n["patches"].cast("int"))
        row = F.concat(F.array_join(F.array_repeat(tile, n["columns"].cast("int")), beside), F.lit(below))
        tiles = F.when(n["rows"] * n["columns"] > 1, F.repeat(row, n["rows"].cast("int"))).otherwise(F.lit(""))
        return F.concat(F.lit(start), tiles, F.lit(whole), tile, F.lit(end))

    return lambda counts: F.transform(counts, one)


def leading_ids(name: str, images: Column, tokens_per_image: int, image_id: int) -> Column:
    """Ids in front of a sequence for models that put all images first, else none; their labels are ignored."""
    n = F.coalesce(F.size(images), F.lit(0)) * tokens_per_image if name in FRONT else F.lit(0)
    return F.array_repeat(F.lit(image_id), F.greatest(n, F.lit(0)))


#: Plugins whose images stand in front of the text.
FRONT = ("paligemma",)
_VISION = {"before": "<|vision_start|>", "after": "<|vision_end|>"}
for _name, _kinds in {
    "base": {}, "mllama": {"image": once("<|image|>")}, "paligemma": {"image": once("")}, "gemma3": {"image": crops("<start_of_image>")},
    "llava": {"image": repeated("<image>")}, "llava_next": {"image": repeated("<image>")}, "llava_next_video": {"image": repeated("<image>"), "video": repeated("<video>")},
    "video_llava": {"image": repeated("<image>"), "video": repeated("<video>")}, "pixtral": {"image": lined("[IMG]", "[IMG_BREAK]", "[IMG_END]")},
    "llama4": {"image": tiled("<|patch|>", "<|image|>", "<|image_start|>", "<|image_end|>", "<|tile_x_separator|>", "<|tile_y_separator|>")},
    "minicpm_v": {"image": once("(<image>./</image>)"), "video": repeated("(<image>./</image>)"), "audio": once("(<audio>./</audio>)")},
    "qwen2_vl": {"image": repeated("<|image_pad|>", **_VISION), "video": repeated("<|video_pad|>", **_VISION)},
    "qwen2_audio": {"audio": repeated("<|AUDIO|>", "<|audio_bos|>", "<|audio_eos|>")},
    "qwen2_omni": {
        "image": repeated("<|IMAGE|>", "<|vision_bos|>", "<|vision_eos|>"), "video": repeated("<|VIDEO|>", "<|vision_bos|>", "<|vision_eos|>"),
        "audio": repeated("<|AUDIO|>", "<|audio_bos|>", "<|audio_eos|>"),
    },
}.items():
    register_plugin(_name, **_kinds)


def process(messages: Column, name: str, **counts: Column) -> Column:
    """Messages with all kinds of media expanded as the named model writes them; ``counts``: tokens of each medium, by kind."""
    check_support(name, set(counts))
    return reduce(lambda m, kind: expanded_messages(m, kind, plugin(name)[kind](counts[kind])), counts, messages)


# --- from sizes to counts -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Geometry:
    """How a model's processor sees pictures: side of a patch, patches merged per side, further tokens, and the bounds of their pixels."""

    patch: int = 14
    merge: int = 2
    extra: int = 0
    drop_first: bool = False
    most: int = 768 * 768
    least: int = 32 * 32
    frames_merged: int = 2


def snapped(height: Column, width: Column, g: Geometry) -> tuple[Column, Column]:
    """(height, width) in multiples of a merged patch, the area kept between its bounds and the aspect nearly the same."""
    unit = g.patch * g.merge
    to = lambda x, f: F.greatest(F.lit(unit), (f(x / unit) * unit).cast("int"))
    h, w, area = to(height, F.bround), to(width, F.bround), (height * width).cast("double")
    shrink, grow = F.sqrt(area / g.most), F.sqrt(F.lit(float(g.least)) / area)
    pick = lambda side, own: F.when(h * w > g.most, to(side / shrink, F.floor)).when(h * w < g.least, to(side * grow, F.ceil)).otherwise(own)
    return pick(height, h), pick(width, w)


Counter = Callable[[Column, Geometry], Column]  #: a medium's size -> how many tokens, or what a plugin's pieces ask for
_COUNTERS: dict[tuple[str, str], Counter] = {}


def register_counter(name: str, kind: str, f: Counter) -> None:
    """How many tokens a plugin's medium of a size has; sizes are structs of what is needed (height, width, frames)."""
    if (name, kind) in _COUNTERS:
        raise ValueError(f"counter {name} {kind} exists")
    _COUNTERS[name, kind] = f


def counts(name: str, kind: str, sizes: Column, geometry: Geometry = Geometry()) -> Column:
    """The counts that the plugin's pieces take, of an array of sizes; null sizes have null counts."""
    if (name, kind) not in _COUNTERS:
        raise ValueError(f"{name} does not count {kind}s by size")
    return F.transform(sizes, lambda m: F.when(m.isNotNull(), _COUNTERS[name, kind](m, geometry)))


def _flat(m: Column, g: Geometry) -> Column:
    return patches(m["height"], m["width"], g.patch, g.extra, g.drop_first)


def _merged(m: Column, g: Geometry) -> Column:
    h, w = snapped(m["height"], m["width"], g)
    return merged_grid(F.lit(1), div(h, g.patch), div(w, g.patch), g.merge)


def _merged_frames(m: Column, g: Geometry) -> Column:
    h, w = snapped(m["height"], m["width"], g)
    return merged_grid(F.ceil(m["frames"] / g.frames_merged), div(h, g.patch), div(w, g.patch), g.merge)


for _name, _kind, _f in (
    ("llava", "image", _flat), ("llava_next", "image", _flat), ("llava_next_video", "image", _flat), ("video_llava", "image", _flat),
    ("llava_next_video", "video", lambda m, g: pooled_frames(m["height"], m["width"], g.patch, m["frames"])),
    ("video_llava", "video", lambda m, g: patches(m["height"], m["width"], g.patch, g.extra) * m["frames"]),
    ("pixtral", "image", lambda m, g: F.struct(div(m["height"], g.patch).alias("rows"), div(m["width"], g.patch).alias("columns"))),
    ("qwen2_vl", "image", _merged), ("qwen2_omni", "image", _merged), ("qwen2_vl", "video", _merged_frames), ("qwen2_omni", "video", _merged_frames),
    ("qwen2_audio", "audio", lambda m, g: audio_tokens(m["frames"])), ("qwen2_omni", "audio", lambda m, g: audio_tokens(m["frames"])),
):
    register_counter(_name, _kind, _f)


def process_sizes(messages: Column, name: str, geometry: Geometry = Geometry(), **sizes: Column) -> Column:
    """``process`` from the sizes of the media (array<struct>, by kind) in place of their counts."""
    check_support(name, set(sizes))
    return process(messages, name, **{kind: counts(name, kind, of, geometry) for kind, of in sizes.items()})


# --- sound inside of videos ---------------------------------------------------------------------------------------

#: Places of a second on the common clock, and places of a chunk.
PER_SECOND, PER_CHUNK = 25, 50


def time_chunks(frames: Column, tokens: Column, seconds: Column) -> Column:
    """array<int>: how many tokens each time chunk of a video gets, of ``frames`` with ``tokens`` each, ``seconds`` apart.

    Tokens are gone through in order, and each can open one chunk at most: a frame that lies several chunks ahead opens the first
    of them with its first token, the next with its second, and so on.
    """
    zero, none_yet = F.lit(0).cast("long"), F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(1).cast("long").alias("chunk"), zero.alias("begin"), none_yet.alias("sizes"))
    tokens = tokens.cast("long")

    def frame(s: Column, i: Column) -> Column:
        time = F.floor(i * seconds * PER_SECOND)
        opened = F.least(tokens, F.greatest(zero, F.floor(time / PER_CHUNK) - s["chunk"] + 1))
        sizes = F.concat(s["sizes"], F.array(i * tokens - s["begin"]), F.array_repeat(F.lit(1).cast("long"), (opened - 1).cast("int")))
        after = F.struct((s["chunk"] + opened).alias("chunk"), (i * tokens + opened - 1).alias("begin"), sizes.alias("sizes"))
        return F.when(opened > 0, after).otherwise(s)

    at = F.when(frames > 0, F.sequence(zero, frames.cast("long") - 1)).otherwise(none_yet)
    return F.aggregate(at, start, frame, lambda s: F.concat(s["sizes"], F.array(frames.cast("long") * tokens - s["begin"])))


def sound_chunks(tokens: Column) -> Column:
    """array<int>: the sound's tokens by chunk, the last one shorter; one empty chunk without any."""
    n = F.greatest(F.lit(1), F.ceil(tokens / PER_CHUNK)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(F.lit(PER_CHUNK), tokens - j * PER_CHUNK).cast("long"))


def with_sound(videos: Column, sounds: Column, merge: int = 2) -> Column:
    """array<string>: each video's tokens and its sound's, merged by time chunk.

    ``videos`` is array<struct<t, h, w, seconds>> (grid, and seconds between its frames), ``sounds`` the tokens of each sound.
    """
    def one(v: Column, i: Column) -> Column:
        pictures = time_chunks(v["t"], div(v["h"], merge) * div(v["w"], merge), v["seconds"])
        heard = sound_chunks(F.get(sounds, i))
        run = lambda token, n: F.repeat(F.lit(token), F.coalesce(n, F.lit(0)).cast("int"))
        chunks = F.transform(F.arrays_zip(pictures.alias("p"), heard.alias("s")), lambda z: F.concat(run("<|VIDEO|>", z["p"]), run("<|AUDIO|>", z["s"])))
        return F.concat(F.lit("<|vision_bos|><|audio_bos|>"), F.array_join(chunks, ""), F.lit("<|audio_eos|><|vision_eos|>"))

    return F.transform(videos, one)


def videos_with_sound(messages: Column, videos: Column, sounds: Column, merge: int = 2) -> Column:
    """Messages whose videos carry their sound: a video's placeholder takes both, and a sound's placeholder of that message goes."""
    count = lambda kind: F.aggregate(messages, F.lit(0), lambda a, m: a + placeholder_count(m["content"], kind))
    silent = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), _without(m["content"], "audio", placeholder_count(m["content"], "video")).alias("content")))
    fits = (count("video") == F.coalesce(F.size(sounds), F.lit(0))) & (F.coalesce(F.size(videos), F.lit(0)) == F.coalesce(F.size(sounds), F.lit(0)))
    wrong = F.raise_error(F.lit("each video needs a placeholder and a sound")).cast("array<struct<role:string,content:string>>")
    return F.when(fits, expanded_messages(silent, "video", with_sound(videos, sounds, merge))).otherwise(wrong)


def _without(text: Column, kind: str, n: Column) -> Column:
    """The text less its first n placeholders of a kind."""
    parts = F.split(text, PLACEHOLDERS[kind], -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) | (i <= n), p).otherwise(F.concat(F.lit(PLACEHOLDERS[kind]), p))), "")

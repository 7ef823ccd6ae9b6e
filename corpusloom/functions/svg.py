"""Vector graphics: markup to semantic tokens and back, and the simplifications before it.

A tree walk has no relational form, so the public functions are Arrow-batched string functions; colours, path numbers and
token clean-up are native columns.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SVG_NS, XLINK = "{http://www.w3.org/2000/svg}", "{http://www.w3.org/1999/xlink}"
ET.register_namespace("", SVG_NS[1:-1])
ET.register_namespace("xlink", XLINK[1:-1])

# --- Fixed values: the token vocabulary ---------------------------------------------------------------------------

PATH_COMMANDS = {
    "m": "moveto", "l": "lineto", "h": "horizontal_lineto", "v": "vertical_lineto", "c": "curveto", "s": "smooth_curveto",
    "q": "quadratic_bezier_curve", "t": "smooth_quadratic_bezier_curveto", "a": "elliptical_Arc", "z": "close_the_path",
}
SHAPES = ("circle", "rect", "ellipse", "polygon", "line", "polyline", "text")
GRADIENTS = ("linearGradient", "radialGradient", "stop")
CONTAINERS = {"<svg>": "START_OF_SVG", "</svg>": "END_OF_SVG", "<g>": "start_of_g", "</g>": "end_of_g"}
ATTRIBUTES = (
    "id", "d", "fill", "stroke-width", "stroke-linecap", "stroke", "opacity", "transform", "gradientTransform", "offset", "width", "height", "cx", "cy", "rx", "ry", "r",
    "points", "x1", "y1", "x2", "y2", "x", "y", "fr", "fx", "fy", "href", "rotate", "font-size", "font-style", "font-family", "text-content",
)
ATTRIBUTE_NAMES = {"id": "tag_id", "d": "path_d"}  #: tokens that are not named as their attribute

#: Text of a structure -> token, in order of precedence.
VOCABULARY = (
    {"<path>": "[<|svg_path|>]"} | {f"[{c}]": f"[<|{n}|>]" for c, n in PATH_COMMANDS.items()} | {f"<{s}>": f"[<|svg_{s}|>]" for s in SHAPES}
    | {t: f"[<|{n}|>]" for t, n in CONTAINERS.items()} | {f"<{g}>": f"[<|svg_{g}|>]" for g in GRADIENTS} | {f"_{a}_": f"[<|{ATTRIBUTE_NAMES.get(a, a)}|>]" for a in ATTRIBUTES}
)
_TOKEN_OF = re.compile("|".join(map(re.escape, VOCABULARY)))

IGNORED_TAGS, IGNORED_ATTRIBUTES = ("clipPath",), ("clip-path", "gradientUnits")
SHAPE_ATTRIBUTES = (
    "fill", "stroke-width", "stroke", "opacity", "transform", "cx", "cy", "r", "rx", "ry", "width", "height", "points", "x1", "y1", "x2", "y2", "x", "y", "dx", "dy",
    "rotate", "font-size", "textLength", "font-style", "font-family",
)
NUMBERS = {"cx", "cy", "rx", "ry", "r", "x1", "y1", "x2", "y2", "x", "y", "dx", "dy", "rotate", "font-size", "textLength", "stroke-width", "opacity"}
TEXT_ATTRIBUTES = ("x", "y", "dx", "dy", "rotate", "font-size", "textLength", "font-style")
PATH_ATTRIBUTES = ("fill", "stroke", "stroke-linecap", "stroke-width", "opacity")

# --- Markup to structure to tokens --------------------------------------------------------------------------------


def number_text(text: str) -> str:
    """A whole number if integral, else two decimals (exact binary rounding)."""
    value = float(text)
    return str(int(value)) if value.is_integer() else str(round(value, 2))


def path_text(d: str) -> str:
    """Commands in brackets with their numbers; letters are commands whatever they stand for."""
    out = []
    for command, values in re.findall(r"([a-zA-Z])\s*([-0-9.,\s]*)", d):
        if command == "z":
            out.append("[z]")
        else:
            out.append(f"[{command}]{' '.join(map(number_text, re.findall(r'[-+]?\d*\.?\d+(?:e[-+]?\d+)?', values)))} ")
    return "".join(out)


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


@dataclass
class Structure:
    """Walks a tree and collects indented lines; gradients go to a table of their own."""

    gradient_tags: bool = False
    path_only: bool = False
    groups: bool = True
    inherit: bool = True
    ignore_tags: tuple[str, ...] = IGNORED_TAGS
    ignore_attributes: tuple[str, ...] = IGNORED_ATTRIBUTES
    lines: list[str] = field(default_factory=list)
    gradients: dict[str, str] = field(default_factory=dict)

    def put(self, depth: int, text: str) -> None:
        self.lines.append("  " * depth + text + "\n")

    def walk(self, element: ET.Element, depth: int = 0, inherited: dict | None = None) -> None:
        tag, inherited = _local(element.tag), inherited or {}
        if not tag or tag in self.ignore_tags:
            return
        if tag == "g" and self.inherit:
            inherited = {**inherited, **element.attrib}
            if self.groups:
                self.put(depth, f"<g> (_{inherited}_)")
            for child in element:
                self.walk(child, depth + 1, inherited)
            if self.groups:
                self.put(depth, "</g>")
            return
        if tag not in GRADIENTS:
            self.put(depth, f"<{tag}>")
        own = {**element.attrib, **inherited}  # what a group says goes before what the element says
        if tag == "path" and "d" in own:
            self._path(own, depth + 1)
        elif tag == "text":
            said = "".join(f"_{a}_{v}" for a, v in element.attrib.items() if a in TEXT_ATTRIBUTES)
            self.put(depth + 1, f"{said}_text-content_{element.text or ''}")
        elif tag in SHAPES and not self.path_only:
            self.put(depth + 1, "".join(self._shape(own)))
        elif tag in GRADIENTS:
            self._gradient(element, tag, own)
        for child in element:
            self.walk(child, depth + 1, inherited)
        if tag == "svg":
            self.put(depth, "</svg>")

    def _path(self, own: dict, depth: int) -> None:
        drawn = "_d_" + path_text(own["d"])
        if self.gradient_tags and own.get("fill") in self.gradients:
            self.put(depth, drawn)
            self.put(depth, self.gradients[own["fill"]])
            return
        for a in PATH_ATTRIBUTES:
            if own.get(a):
                drawn += f" _{a}_{number_text(own[a]) if a in NUMBERS else own[a]}"
        self.put(depth, drawn)

    def _shape(self, own: dict) -> Iterator[str]:
        for a, v in own.items():
            if a in SHAPE_ATTRIBUTES and a not in self.ignore_attributes:
                yield f"_{a}_{number_text(v) if a in NUMBERS else v} "

    def _gradient(self, element: ET.Element, tag: str, own: dict) -> None:
        if not (name := own.get("id")):
            return
        said = f"<{tag}> " + " ".join(f"_{a}_{'#' + v if a == 'id' else v}" for a, v in own.items() if a != "gradientUnits" and a not in self.ignore_attributes)
        target = own.get(XLINK + "href")
        if target is None:
            self.gradients[f"url(#{name})"] = said
        elif (base := self.gradients.get(f"url(#{target.rpartition('#')[2]})")) is not None:
            self.gradients[f"url(#{name})"] = said + base
        for child in element:
            if _local(child.tag) == "stop" and f"url(#{name})" in self.gradients:
                shown = " ".join(f"_{a}_{v}" for a, v in child.attrib.items() if a in ("offset", "stop-color"))
                self.gradients[f"url(#{name})"] += f"<stop>{shown} </stop>"


def to_tokens(structure: str) -> str:
    """Structure text as tokens, without blanks around brackets."""
    text = _TOKEN_OF.sub(lambda m: VOCABULARY[m[0]], structure.replace("\n", ""))
    for pattern, to in ((r"\]\s+\[", "]["), (r"\s*\[\s*", "["), (r"\s*\]\s*", "]"), (r"(\d)\s+", r"\1 "), (r"\]\s*\[", "][")):
        text = re.sub(pattern, to, text)
    return text


def encode(svg: str, **options) -> tuple[str, str]:
    """(structure, tokens) of a markup string; raises on text that is no XML."""
    s = Structure(**options)
    s.walk(ET.fromstring(svg))
    structure = "".join(s.lines)
    return structure, to_tokens(structure)


# --- Tokens to markup ---------------------------------------------------------------------------------------------

HEADER = '<svg height="128" width="128" viewBox="0 0 128 128" xmlns="http://www.w3.org/2000/svg">'
_COMMON = ("fill", "opacity", "stroke", "stroke-width", "stroke-linecap")
#: shape -> (attributes taken, attributes needed)
_TAKES = {
    "ellipse": (("cx", "cy", "rx", "ry"), ("rx", "ry")), "rect": (("width", "height", "x", "y", "rx", "ry"), ("width", "height")), "circle": (("r", "cx", "cy"), ("r",)),
    "line": (("x1", "y1", "x2", "y2"), ()), "polygon": (("points",), ("points",)), "polyline": (("points",), ("points",)),
}
_OPENERS = (*(f"svg_{s}" for s in SHAPES), "svg_path", *(f"svg_{g}" for g in GRADIENTS), *CONTAINERS.values())
_LETTER = {n: c for c, n in PATH_COMMANDS.items()}


def attribute_text(attributes: dict[str, str]) -> str:
    return " ".join(f"{k.replace('_', '-')}='{v}'" for k, v in attributes.items() if v is not None and k != "text-content" and not k.startswith("_"))


class Decoder:
    """Builds markup from tokens; an element is written when the following token opens something and nothing needed is missing."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.open: list[str] = []
        self.groups: list[dict[str, str]] = []
        self.attributes: dict[str, str] = {}
        self.path: list[str] = []
        self.text: str | None = None
        self.gradient: str | None = None

    def run(self, tokens: str) -> str:
        parts = tokens.split("[<|")
        for i, part in enumerate(parts):
            if "|>]" in part:
                name, content = (x.strip() for x in part.split("|>]", 1))
                after = parts[i + 1] if i + 1 < len(parts) else None
                self.token(name, content, after is not None and any(o in after for o in _OPENERS), after or "")
        for element in reversed(self.open):
            if element == "g" or element in GRADIENTS:
                self.out.append(f"</{element}>")
        return "".join(self.out)

    def token(self, name: str, content: str, ends: bool, after: str) -> None:
        if name == "START_OF_SVG":
            self.out.append(HEADER)
        elif name == "END_OF_SVG":
            self.out.append("</svg>")
        elif name == "start_of_g":
            self.open.append("g")
            self.groups.append({})
            self.out.append("<g>")
        elif name == "end_of_g":
            if self.open[-1:] == ["g"]:
                self.open.pop()
                self.groups = self.groups[:-1]
                self.out.append("</g>")
        elif name == "svg_stop":
            if self.open and self.open[-1] in GRADIENTS:
                self.out.append("<stop  />")
        elif name.startswith("svg_") and name in _OPENERS:
            self.open.append(name[4:])
            self.attributes, self.text = {}, None
            if name == "svg_path":
                self.path = []
        elif self.open:
            self.content(self.open[-1], name, content, ends, after)

    def content(self, element: str, name: str, content: str, ends: bool, after: str) -> None:
        key = name.replace("_", "")
        if element == "g":
            if self.groups:
                self.groups[-1][key] = content
        elif element == "path":
            if name == "path_d" or name in _LETTER:
                self.path.append(_LETTER.get(name, "") + content)
            elif name in _COMMON:
                self.attributes[key] = content
            if ends:
                for group in self.groups:
                    self.attributes |= {k: v for k, v in group.items() if k not in self.attributes}
                self.close(f'<path d="{"".join(self.path)}" {attribute_text(self.attributes)} />')
                self.path = []
        elif element == "text":
            if name == "text-content":
                self.text = content
            else:
                self.attributes[key] = content
            if ends:
                self.close(f"<text {attribute_text(self.attributes)}>{self.text or ''}</text>")
        elif element in _TAKES:
            takes, needs = _TAKES[element]
            if name in takes or name in _COMMON:
                self.attributes[key] = content
            if ends and all(n in self.attributes for n in needs):
                self.close(f"<{element} {attribute_text(self.attributes)} />")
        else:  # a gradient; it stays open for its stops
            if name == "id":
                self.gradient = content
            self.attributes["id" if name == "id" else key] = content
            if self.gradient and (ends or "svg_stop" in after):
                self.out.append(f"<{element} {attribute_text(self.attributes)}>")

    def close(self, markup: str) -> None:
        self.out.append(markup)
        self.open.pop()


def decode(tokens: str) -> str:
    return Decoder().run(tokens)


def safe_decode(tokens: str) -> str:
    try:
        return decode(tokens)
    except Exception as e:
        return f"<error>Decoding failed: {e}</error>"


# --- Simplification -----------------------------------------------------------------------------------------------


def hex_to_rgb(text: str) -> tuple[int, int, int]:
    if not re.fullmatch(r"#?[0-9A-Fa-f]{6}", text):
        raise ValueError(f"no six-digit colour: {text}")
    n = int(text.lstrip("#"), 16)
    return n >> 16, n >> 8 & 255, n & 255


def _gradient_colours(root: ET.Element) -> dict[str, str]:
    """First stop colour (an attribute) of each gradient; one without stops takes that of the gradient it points to."""
    found = [g for kind in ("radialGradient", "linearGradient") for g in root.iter(SVG_NS + kind)]
    by_id = {g.get("id"): g for g in reversed(found) if g.get("id") is not None}
    colours: dict[str, str] = {}

    def colour(name: str, seen: frozenset = frozenset()) -> str | None:
        g = by_id.get(name)
        if g is None or name in seen:  # chains may close
            return None
        stop = next(g.iter(SVG_NS + "stop"), None)
        if stop is not None and stop.get("stop-color") is not None:
            return stop.get("stop-color")
        target = g.get(XLINK + "href")
        return colour(target[1:], seen | {name}) if target else None

    for name in by_id:
        if (c := colour(name)) is not None:
            colours[name] = c
    return colours


def flatten_gradients(svg: str, empty_fill: str = "previous", default: str = "#fffff") -> str:
    """Gradient fills of paths become plain colours, gradients go. A path without a fill takes the mean of the valid fills before it
    (``previous``, filled ones included), stays (``skip``) or takes ``default``.
    """
    root = ET.fromstring(svg)
    colours = _gradient_colours(root)
    n, sums = 0, [0, 0, 0]
    for path in root.iter(SVG_NS + "path"):
        fill = path.get("fill")
        if fill is None and empty_fill == "previous" and n:
            path.set("fill", "#" + "".join(f"{s // n:02x}" for s in sums))
        elif fill is None and empty_fill not in ("previous", "skip"):
            path.set("fill", default)
        elif fill and fill.startswith("url(#"):
            path.set("fill", colours.get(fill[5:-1], fill))
        try:
            rgb = hex_to_rgb(path.get("fill") or "")
        except ValueError:
            continue
        n, sums = n + 1, [a + b for a, b in zip(sums, rgb, strict=True)]
    for parent in list(root.iter()):
        for child in [c for c in parent if _local(c.tag) in GRADIENTS[:2]]:
            parent.remove(child)
    return ET.tostring(root, encoding="unicode")


def strip_svg(svg: str) -> str:
    """The children of the outer tag, without namespaces; other markup as it is."""
    root = ET.fromstring(svg)
    if root.tag != SVG_NS + "svg":
        return svg
    for e in root.iter():
        e.tag = _local(e.tag)
    return "".join(ET.tostring(e, encoding="unicode") for e in root)


def flatten_groups(svg: str) -> str:
    """Groups go, their attributes pass to children that lack them."""
    root = ET.fromstring(svg)

    def lifted(parent: ET.Element) -> None:
        out = []
        for child in list(parent):
            if child.tag == SVG_NS + "g":
                for inner in child:
                    for a, v in child.attrib.items():
                        inner.attrib.setdefault(a, v)
                out += list(child)
            else:
                out.append(child)
        again = any(c.tag == SVG_NS + "g" for c in out)
        parent[:] = out
        if again:
            lifted(parent)
        for child in parent:
            lifted(child)

    lifted(root)
    return ET.tostring(root, encoding="unicode")


@dataclass(frozen=True)
class Simplify:
    """Which steps a row takes, in this order."""

    gradients: bool = True
    empty_fill: str = "previous"
    strip: bool = False
    flatten: bool = True
    tokens: bool = True


def prepared(svg: str | None, steps: Simplify = Simplify()) -> tuple[str | None, str, str | None]:
    """(text, structure, error): the last text that worked, if a step fails."""
    text, structure = svg, "no struct_svg"
    try:
        if steps.gradients:
            text = flatten_gradients(text, steps.empty_fill)
        if steps.strip:
            text = strip_svg(text)
        if steps.flatten:
            text = flatten_groups(text)
        if steps.tokens:
            structure, text = encode(text)
    except Exception as e:
        return text, structure, f"{type(e).__name__}: {e}"
    return text, structure, None


# --- Columns ------------------------------------------------------------------------------------------------------


def prepare(df: DataFrame, svg_col: str = "svg_code", steps: Simplify = Simplify(), debug: bool = False) -> DataFrame:
    """svg_text and error; with ``debug`` also svg_raw and struct_svg."""

    @F.pandas_udf("svg_text string, struct_svg string, error string")
    def run(svgs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prepared(s, steps) for s in svgs], columns=["svg_text", "struct_svg", "error"])

    out = df.withColumn("__p", run(svg_col)).withColumns({"svg_text": F.col("__p.svg_text"), "error": F.col("__p.error")})
    if debug:
        out = out.withColumns({"svg_raw": F.col(svg_col), "struct_svg": F.col("__p.struct_svg")})
    return out.drop("__p")


def decode_column(tokens: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else safe_decode(t))

    return run(tokens)


def trimmed(text: Column) -> Column:
    """Cut after the end mark, in tokens or markup, if there is one."""
    marks = ("[<|END_OF_SVG|>]", "</svg>")
    out = text
    for mark in reversed(marks):
        at = F.locate(mark, text) if isinstance(text, str) else F.position(F.lit(mark), text)
        out = F.when(at > 0, F.substring(text, F.lit(1), at + len(mark) - 1)).otherwise(out)
    return out


def rgb(hex_colour: Column) -> Column:
    """struct<r, g, b> of a six-digit colour; null for anything else."""
    ok = hex_colour.rlike("^#?[0-9A-Fa-f]{6}$")
    digits = F.ltrim(hex_colour, F.lit("#"))
    part = lambda i: F.when(ok, F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("int"))
    return F.when(ok, F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def mean_colour(colours: Column) -> Column:
    """Channel-wise mean, rounded down, of an array of colours; null for an empty one."""
    parts = F.transform(colours, rgb)
    total = lambda c: F.aggregate(parts, F.lit(0), lambda a, x: a + x[c])
    n = F.size(colours)
    return F.when(n > 0, rgb_to_hex(*(F.floor(total(c) / n) for c in "rgb")))


def path_commands(d: Column) -> Column:
    """array<struct<command, numbers>> of a path, numbers as they are written."""
    found = F.regexp_extract_all(d, F.lit(r"[a-zA-Z](?U)\s*[-0-9.,\s]*"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substring(x, 1, 1).alias("command"), F.regexp_extract_all(F.substring(x, F.lit(2), F.length(x)), F.lit(r"[-+]?\d*\.?\d+"), F.lit(0)).alias("numbers")))


def is_closed(d: Column) -> Column:
    return F.lower(F.rtrim(d)).endswith("z")


def elements(tokens: Column) -> Column:
    """array<struct<command, attribute>>: bracketed commands and what follows each."""
    found = F.regexp_extract_all(tokens, F.lit(r"\[[^\]]+\][^\[]*"), F.lit(0))
    cut = lambda x: F.position(F.lit("]"), x)
    return F.transform(found, lambda x: F.struct(F.trim(F.substring(x, F.lit(2), cut(x) - 2)).alias("command"), F.trim(F.substring(x, cut(x) + 1, F.length(x))).alias("attribute")))


def vocabulary(num: bool = False, coord: bool = False, colour: bool = False, mask: bool = False, text: bool = False, image: bool = False) -> tuple[list[str], list[str]]:
    """(plain, special) tokens that a base tokenizer gets on top."""
    special = [f"[<|{n}|>]" for n in ("START_OF_SVG", "END_OF_SVG")]
    plain = [t for t in dict.fromkeys(VOCABULARY.values()) if t not in special]
    plain += ["[<|COORD|>]"] * num + ["[<|NUM_X|>]", "[<|NUM_Y|>]"] * coord + ["[<|COLOR|>]"] * colour + ["[<|MASK|>]"] * mask
    special += ["[<|START_OF_TEXT|>]", "[<|END_OF_TEXT|>]"] * text + ["[<|START_OF_IMG|>]", "[<|IMG|>]", "[<|END_OF_IMG|>]"] * image
    return plain, sorted(set(special))


def pad_token(kind: str, eos: str | None) -> str:
    """Which padding token a configuration means; the end token where there is one."""
    known = {"[<|pad|>]": "[<|PAD|>]", "[pad]": "[PAD]"}
    return known.get(kind.lower(), eos if kind.lower() == "eos_token" and eos else "[PAD]")


# --- Prompts ------------------------------------------------------------------------------------------------------

#: The prompt texts around caption and drawing.
ALPACA = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."


def drawing_prompt(style: str, caption: Column, drawing: Column | None = None, eos: str = "") -> Column:
    """Prompt (and answer) of a training style: ``caption``, ``instruct`` or ``alpaca``; without a drawing, the inference prompt."""
    answer = [drawing] if drawing is not None else []
    if style == "caption":
        return F.concat(caption, F.lit(". output:"), *answer)
    if style == "instruct":
        return F.concat(F.lit("Instruct: "), caption, F.lit("\nOutput: "), *answer)
    if style == "alpaca":
        head = f"{ALPACA}\n\n### Instruction:\nGenerate an SVG illustration from the given description.\n\n### Input:\nSVG illustration of "
        return F.concat(F.lit(head), caption, F.lit("\n\n### Response:" + "\n" * bool(answer)), *answer, *([F.lit(eos)] if answer and eos else []))
    raise ValueError(f"unknown style {style}")

"""Dataset keys out of raster paths.

A pattern such as ``/data/{sensor}/{date}_{band}{}.tif`` names key columns by
placeholders. A named placeholder holds letters and digits only, an empty one
anything within one path level, a repeated one must repeat its text, and
doubled braces stand for themselves. A path matches as a whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_TEXT = r"([\p{L}\p{N}]+)"
ANY_TEXT = r"[^/]*?"
TOKEN = re.compile(r"(?P<brace>\{\{|\}\})|\{(?P<name>[^{}]*)\}|(?P<text>[^{}]+)|(?P<stray>[{}])")


@dataclass(frozen=True)
class PathPattern:
    keys: tuple[str, ...]
    regex: str
    glob: str


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Placeholder:
    """Without a name it stands for any text."""

    name: str


def segments(pattern: str) -> list[Literal | Placeholder]:
    """The pattern cut into literal text and placeholders."""
    out: list[Literal | Placeholder] = []
    for token in TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group(token.lastgroup)
        if kind == "stray":
            raise ValueError(f"invalid pattern: single {text!r} at {token.start()}")
        if kind == "name" and text and not re.fullmatch(r"\w+", text):
            raise ValueError("placeholder names must be alphanumeric")
        out.append(Placeholder(text) if kind == "name" else Literal(text[0] if kind == "brace" else text))
    return out


def java_regex(parts: list[Literal | Placeholder]) -> str:
    """Matches whole paths; group n is the n-th different name."""
    group: dict[str, int] = {}

    def one(part) -> str:
        if isinstance(part, Literal):
            return re.sub(r"(\W)", r"\\\1", part.text)
        if not part.name:
            return ANY_TEXT
        if part.name in group:
            return f"(?:\\{group[part.name]})"
        group[part.name] = len(group) + 1
        return KEY_TEXT

    return f"^{''.join(map(one, parts))}$"


def path_glob(parts: list[Literal | Placeholder]) -> str:
    """Lists at least the paths that the pattern matches."""
    return "".join(re.sub(r"([*?\[\]{}\\])", r"\\\1", p.text) if isinstance(p, Literal) else "*" for p in parts)


def parse_pattern(pattern: str) -> PathPattern:
    parts = segments(pattern)
    keys = tuple(dict.fromkeys(p.name for p in parts if isinstance(p, Placeholder) and p.name))
    if not keys:
        raise ValueError("pattern needs at least one placeholder with a name")
    return PathPattern(keys, java_regex(parts), path_glob(parts))


def keys_from_paths(paths: DataFrame, pattern: str, path_col: str = "path") -> DataFrame:
    """One row per matching path: the key columns of the pattern, then ``path``."""
    p = parse_pattern(pattern)
    path = F.col(path_col)
    return paths.where(path.rlike(p.regex)).select(
        *[F.regexp_extract(path, p.regex, i).alias(k) for i, k in enumerate(p.keys, 1)],
        path.alias("path"),
    )


def duplicate_keys(datasets: DataFrame, keys) -> DataFrame:
    """Key tuples that more than one path leads to."""
    return datasets.groupBy(*keys).agg(F.count("*").alias("n_paths")).where("n_paths > 1")


def require_unique(datasets: DataFrame, keys) -> DataFrame:
    """Raise now if the paths lead to no dataset or to duplicate keys."""
    if datasets.isEmpty():
        raise ValueError("pattern matches no files")
    if not duplicate_keys(datasets, keys).isEmpty():
        raise ValueError("pattern leads to duplicate keys")
    return datasets


def list_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths of the files a pattern can match, listed by Spark; contents are not read."""
    return spark.read.format("binaryFile").load(parse_pattern(pattern).glob).select(
        F.regexp_replace("path", "^file:(//)?", "").alias("path"))


def move_key_last(columns, key: str) -> list[str]:
    """Key order with one key (the one RGB composites vary) moved to the end."""
    if key not in columns:
        raise ValueError(f"{key} is not a key of the pattern")
    return [c for c in columns if c != key] + [key]


def dedup_inputs(paths: DataFrame, path_col: str = "path") -> DataFrame:
    return paths.select(path_col).distinct()


def output_name(path):
    """Name an input is written under: its base name with the suffix ``.tif``."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.concat(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit(".tif"))


def pending_inputs(inputs: DataFrame, outputs: DataFrame, path_col: str = "path") -> DataFrame:
    """Inputs whose output is not there yet."""
    done = outputs.select(F.col(path_col).alias("_output")).distinct()
    return inputs.join(done, output_name(F.col(path_col)) == F.col("_output"), "left_anti")

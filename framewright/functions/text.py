"""Text functions: clean-up, bilingual tasks, prompts, hashes, slugs, paths, parsing."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as true and as false in settings, and as no value.
TRUE_WORDS = ("1", "true", "yes", "y")
FALSE_WORDS = ("0", "false", "no", "n")
NONE_WORDS = ("", "none", "null")

PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def clean_whitespace(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def basic_clean(text: Column) -> Column:
    """Character references resolved twice, as scraped captions need; there is no such function in Spark."""

    @F.pandas_udf(T.StringType())
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(html.unescape(t)).strip())

    return unescaped(text)


def canonical_clean(text: Column, keep: str = "") -> Column:
    """Underscores as spaces, punctuation out, lower case, single spaces."""
    dropped = "".join(c for c in PUNCTUATION if c not in keep and c != "_")
    return clean_whitespace(F.lower(F.translate(F.replace(text, F.lit("_"), F.lit(" ")), dropped, "")))


def side(task: Column, second: bool) -> Column:
    """One side of a task "first@second"; a task without @ is its own first side."""
    parts = F.split(task, "@", 2)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))) if second else F.get(parts, F.lit(0))


def require_two_sides(task: Column, second: bool) -> Column:
    """One side of a task that must have exactly one @."""
    parts = F.split(task, "@")
    fail = F.raise_error(F.concat(F.lit("not two sides: "), task)).cast("string")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(int(second)))).otherwise(fail)


def prompt(task: Column, template: str) -> Column:
    """A template with {task} filled in."""
    before, after = template.split("{task}")
    return F.concat(F.lit(before), task, F.lit(after))


def instruction(high: Column, low: Column, drop_high: float, key: Column, seed: int = 0) -> Column:
    """"[High]: ..., [Low]: ..."; the high part is left out for a share of keys that the seed fixes, by their md5."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    chance = F.conv(F.substring(told, 1, 8), 16, 10).cast("long") / float(1 << 32)
    both = F.concat(F.lit("[High]: "), F.coalesce(high, F.lit("")), F.lit(", [Low]: "), low)
    alone = F.concat(F.lit("[high] "), F.coalesce(high, F.lit("")))
    return F.when(low.isNull(), alone).when(chance < drop_high, low).otherwise(both)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def shape_hash(entries: Column) -> Column:
    """MD5 of sorted "key:shape" entries."""
    return F.md5(F.array_join(F.sort_array(entries), ","))


def slug(text: Column, most: int = 50) -> Column:
    """Lower case, other than letters and digits as one underscore, none at the ends, at most so many characters."""
    low = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(low, "^_+|_+$", ""), 1, most)


def episode_path(episode: Column, chunk: int = 1000) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk), episode)


def video_path(episode: Column, camera: Column, chunk: int = 1000) -> Column:
    return F.format_string("videos/chunk-%03d/%s/episode_%06d.mp4", F.floor(episode / chunk), camera, episode)


def step_of(path: Column) -> Column:
    """The number at the end of "...step_N" or "...step-N"; null without one."""
    return F.nullif(F.regexp_extract(path, r"step[_-](\d+)$", 1), F.lit("")).cast("long")


def frame_number(path: Column) -> Column:
    """The number after the last underscore of a frame's file name, by which frames sort; null without one."""
    return F.nullif(F.regexp_extract(path, r"_(\d+)\.[^._]*$", 1), F.lit("")).cast("long")


def parse_bool(word: Column) -> Column:
    low = F.lower(F.trim(word))
    fail = F.raise_error(F.concat(F.lit("not a truth value: "), word)).cast("boolean")
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).when(word.isNotNull(), fail)


def optional_number(word: Column) -> Column:
    """A number, or null for the words that mean none."""
    return F.when(~F.lower(F.trim(word)).isin(*NONE_WORDS), F.trim(word).try_cast("double"))


def percentage(share: Column) -> Column:
    return F.format_string("%.2f", share * 100.0)


def squeezed_name(path: Column) -> Column:
    """The last part of a path in lower case, letters and digits only; "textenc" if nothing is left."""
    base = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), "[^a-z0-9]+", "")
    return F.when(base == "", F.lit("textenc")).otherwise(base)


def run_tag(path: Column) -> Column:
    """The two parts after "runs", joined; else the file's name without its ending."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "runs").cast("int")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    two = F.concat(F.get(parts, at), F.lit("_"), F.get(parts, at + 1))
    return F.when((at > 0) & (F.size(parts) > at + 1), two).otherwise(stem)


def phase_file(phase: Column) -> Column:
    fail = F.raise_error(F.concat(F.lit("no such phase: "), phase)).cast("string")
    known = phase.isin("clean", "random")
    return F.when(known, F.concat(F.lit("_result_"), phase, F.lit(".txt"))).otherwise(fail)

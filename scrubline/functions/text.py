"""Text cleaning. Missing values stay missing in every function."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, replace_column, require_text

# Unicode-aware patterns. The blanks are those of the White_Space property and the
# four separator controls.
EDGE_BLANKS = r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"
BLANK_RUN = r"(?U)[\s\x1C-\x1F]+"
SPECIAL = r"(?U)[^A-Za-z0-9\s\x1C-\x1F]"


def trim(value: Column) -> Column:
    return F.regexp_replace(value, EDGE_BLANKS, "")


@F.arrow_udf(T.StringType())
def title(value: pa.Array) -> pa.Array:
    """A capital after everything that is no cased letter: ``it's o-neil`` becomes ``It'S O-Neil``.

    ``initcap`` only looks at blanks. ASCII texts are turned in one call on the batch; for others the letters that
    become two, or have a form of their own at the beginning of a word, need Python's own rule.
    """
    ascii_only = pc.fill_null(pc.string_is_ascii(value), True)
    out = pc.utf8_title(value)
    if not pc.all(ascii_only).as_py():
        other = pc.invert(ascii_only)
        out = pc.replace_with_mask(out, other, pa.array([x.title() for x in value.filter(other).to_pylist()], out.type))
    return out


def remove_special(value: Column) -> Column:
    """Drop everything but ASCII letters, digits and whitespace."""
    return F.regexp_replace(value, SPECIAL, "")


def collapse_spaces(value: Column) -> Column:
    return trim(F.regexp_replace(value, BLANK_RUN, " "))


ACTIONS = {
    "trim": trim,
    "lower": F.lower,
    "upper": F.upper,
    "title": title,
    "remove_special": remove_special,
    "collapse_spaces": collapse_spaces,
}


def clean_text(df: DataFrame, name: str, action: str) -> DataFrame:
    """Apply one of ``ACTIONS`` to a text column."""
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {sorted(ACTIONS)}")
    require_text(df, name)
    return replace_column(df, name, ACTIONS[action](col(name)))


def java_regex(pattern: str) -> str:
    """A Python pattern with its named groups spelled for the JVM."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern))


def java_replacement(text: str) -> str:
    """A Python replacement template with its group references spelled for the JVM."""
    out = text.replace("$", "\\$")
    out = re.sub(r"\\g<(\d+)>", r"${g\1}", out)
    out = re.sub(r"\\g<([A-Za-z_]\w*)>", r"${\1}", out)
    out = re.sub(r"\\(\d{1,2})", r"${g\1}", out)
    return re.sub(r"\$\{g(\d+)\}", r"$\1", out)


def find_replace(df: DataFrame, name: str, find: str, replacement: str, regex: bool = False) -> DataFrame:
    """Replace every occurrence in a column taken as text."""
    if find == "":
        raise ValueError("the text to find is empty")
    value = col(name).cast("string")
    if regex:
        re.compile(find)
        done = F.regexp_replace(value, F.lit(java_regex(find)), F.lit(java_replacement(replacement)))
    else:
        done = F.replace(value, F.lit(find), F.lit(replacement))
    return replace_column(df, name, done)

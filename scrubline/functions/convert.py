"""Text to number, date and text conversions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import (
    col, columns_of, dtype, is_datetime, is_numeric, is_text, replace_column, wall_time,
)

# The number syntax accepted from text (ASCII blanks around it are allowed).
NUMBER = r"^[ \t\r\n\f\x0B]*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)[ \t\r\n\f\x0B]*$"
BLANKS = " \t\r\n\f\x0b"

# Strptime codes and the datetime pattern letters they stand for.
STRPTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "D",
    "%z": "xx", "%Z": "VV", "%%": "%",
}

# The widths of numbers that touch another number, and English weekday names.
FIXED_WIDTH = {"%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%j": "DDD"}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CENTURY_YEAR = 69  # two-digit years from here on belong to the 20th century
YEARLESS = 1900  # the year of a time whose format has none

# What date detection tries, in this order. The shape keeps a lenient date pattern
# from accepting text of another layout.
DATE_FORMATS = [
    ("%Y-%m-%d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$"),
    ("%Y-%m-%dT%H:%M:%S", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$"),
    ("%Y-%m-%d %H:%M:%S.%f", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$"),
    ("%Y-%m-%dT%H:%M:%S.%f", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}\.\d{1,6}$"),
    ("%Y-%m-%d %H:%M", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$"),
    ("%Y/%m/%d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("%m/%d/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%m-%d-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("%d/%m/%Y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%d-%m-%Y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("%d.%m.%Y", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("%m/%d/%Y %H:%M", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("%m/%d/%Y %H:%M:%S", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("%d %b %Y", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("%d-%b-%Y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("%b %d, %Y", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("%d %B %Y", r"^\d{1,2} [A-Za-z]{3,} \d{4}$"),
    ("%B %d, %Y", r"^[A-Za-z]{3,} \d{1,2}, \d{4}$"),
    ("%Y%m%d", r"^\d{8}$"),
]

# The different shapes, in order: one that is part of another stands before it. No date is longer than the longest month allows.
SHAPES = list(dict.fromkeys(shape for _, shape in DATE_FORMATS))
LONGEST_DATE = 64


def parse_number(value: Column) -> Column:
    """Text as double; NULL for anything that is not a number.

    The pattern guard is needed because a plain cast also takes ``1d`` and ``5f``.
    """
    number = F.btrim(value, F.lit(BLANKS)).try_cast("double")
    # digits beyond the range of a double are no number, the word for infinity is one
    overflow = (F.abs(number) == float("inf")) & value.rlike(r"\d")
    # one inside the other, so that only texts of the pattern are cast: a failing cast is costly
    return F.when(value.rlike(NUMBER), F.when(~overflow, number))


def looks_numeric(value: Column) -> Column:
    """True where a non-null text value parses as a number; the empty text counts as missing."""
    return (value == "") | parse_number(value).isNotNull()


def format_pieces(fmt: str) -> list[str]:
    """The codes and the characters between them."""
    pieces = re.findall(r"%.|[^%]|%$", fmt, re.DOTALL)
    for piece in pieces:
        if piece[0] == "%" and piece not in STRPTIME:
            raise ValueError(f"format code {piece!r} is not supported")
    return pieces


def java_pattern(fmt: str) -> str:
    """A strptime format as a Spark datetime pattern. Numbers without anything between them have fixed widths."""
    numbers = {"%Y", "%y", "%f", *FIXED_WIDTH}
    pieces = format_pieces(fmt)
    out: list[str] = []
    literal = ""
    for before, piece, after in zip(["", *pieces], pieces, [*pieces[1:], ""]):
        if piece[0] != "%" or piece == "%%":
            literal += piece[-1]
            continue
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""
        touches = before in numbers or after in numbers
        out.append(FIXED_WIDTH[piece] if touches and piece in FIXED_WIDTH else STRPTIME[piece])
    if literal:
        out.append("'" + literal.replace("'", "''") + "'")
    return "".join(out)


def parse_timestamp(value: Column, fmt: str) -> Column:
    """Text as wall-clock time by a strptime format; NULL where it does not match.

    The text is read as UTC, so that the session's time zone plays no part. A weekday name may stand at the
    beginning, where it is checked to be one and then left out; elsewhere its code is refused. Without a year,
    the year is 1900; two-digit years lie between 1969 and 2068.
    """
    shape, parsed = dict(DATE_FORMATS).get(fmt), _parsed(value, fmt)
    return F.when(value.rlike(shape), parsed) if shape else parsed


def _instant(text: Column, fmt: str) -> Column:
    """The time of a text by the codes of a format, read as UTC where they name no zone; NULL where it does not match."""
    pattern, codes = java_pattern(fmt), format_pieces(fmt)
    if "%z" not in codes and "%Z" not in codes:
        pattern, text = pattern + " xx", F.concat(text, F.lit(" +0000"))
    return F.try_to_timestamp(text, F.lit(pattern))


def _parsed(value: Column, fmt: str) -> Column:
    """``parse_timestamp`` without a look at the text's shape."""
    text, named, codes = value, None, format_pieces(fmt)
    if codes[:1] in (["%a"], ["%A"]):
        names = WEEKDAYS if codes[0] == "%A" else [w[:3] for w in WEEKDAYS]
        weekday = f"^(?i)(?:{'|'.join(names)})"
        named, text, codes = value.rlike(weekday), F.regexp_replace(value, weekday, ""), codes[1:]
    if "%a" in codes or "%A" in codes:
        raise ValueError("a weekday name is only supported at the beginning of a format")
    parsed = wall_time(F.unix_micros(_instant(text, "".join(codes))))
    if "%y" in codes:
        parsed = F.when(F.year(parsed) >= 2000 + CENTURY_YEAR, parsed - F.expr("interval '100' year")).otherwise(parsed)
    elif "%Y" not in codes:
        parsed = parsed - F.expr(f"interval '{1970 - YEARLESS}' year")
    if named is not None:
        parsed = F.when(named, parsed)
    return parsed


def format_bits(value: Column) -> Column:
    """The formats of ``DATE_FORMATS`` by which a text parses, as bits of a bigint; 0 for none and for NULL.

    The shapes are tried one after the other until one fits, and only formats of that shape parse the text; one that is too long or
    holds no digit meets none. Costly: use it once a row, in a column of its own.
    """
    tried = None
    for shape in SHAPES:
        # a month of three letters may be an abbreviation or a whole name
        own = [k for k, (_, x) in enumerate(DATE_FORMATS) if x in (shape, shape.replace("{3}", "{3,}"))]
        bits = reduce(Column.bitwiseOR, [F.when(_instant(value, DATE_FORMATS[k][0]).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k in own])
        fits = value.rlike(shape)
        tried = F.when(fits, bits) if tried is None else tried.when(fits, bits)
    return F.coalesce(F.when((F.length(value) <= LONGEST_DATE) & value.rlike(r"\d"), tried), F.lit(0)).cast("bigint")


def bit_hits(bits: Column) -> list[Column]:
    """Aggregates that count, per entry of ``DATE_FORMATS``, the texts it parses, given the column of their ``format_bits``."""
    return [F.count_if(bits.bitwiseAND(F.lit(1 << k)) != 0) for k in range(len(DATE_FORMATS))]


def format_hits(value: Column) -> list[Column]:
    """The same of a column of texts, which each aggregate parses anew; for many rows, make a column of ``format_bits`` first."""
    return bit_hits(format_bits(value))


def to_integer(df: DataFrame, name: str) -> DataFrame:
    """Text or number to bigint; unparsable text becomes NULL.

    A fractional or infinite value fails the whole step, at execution: silently cutting the
    fraction would change data. The check is part of the plan, so it needs no extra scan.
    """
    source = col(name)
    if is_text(df, name):
        number = parse_number(source)
        whole = F.btrim(source, F.lit(BLANKS)).try_cast("bigint")
        whole = F.when(source.rlike(NUMBER), whole)
    elif is_numeric(df, name, with_bool=True):
        number, whole = source.cast("double"), source.try_cast("bigint")
    else:
        raise TypeError(f"column {name!r} cannot become an integer")
    bad = number.isNotNull() & ((number != F.floor(number)) | (F.abs(number) == float("inf")))
    message = F.concat(F.lit(f"column '{name}' holds a value that is no integer: "), source.cast("string"))
    exact = F.when(number == F.floor(number), F.coalesce(whole, number.try_cast("bigint")))
    return replace_column(df, name, F.when(bad, F.raise_error(message).cast("bigint")).otherwise(exact))


def to_float(df: DataFrame, name: str) -> DataFrame:
    """Text or number to double; unparsable text becomes NULL."""
    if is_text(df, name):
        return replace_column(df, name, parse_number(col(name)))
    if is_numeric(df, name, with_bool=True):
        return replace_column(df, name, col(name).cast("double"))
    raise TypeError(f"column {name!r} cannot become a number")


def to_text(df: DataFrame, name: str) -> DataFrame:
    """Any scalar column to text; missing values stay missing."""
    dtype(df, name)
    return replace_column(df, name, col(name).cast("string"))


def guess_formats(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """Per text column the date format that parses most values, earlier candidates first; one scan."""
    if not names:
        return {}
    bits = df.select(*[format_bits(col(c)).alias(f"b{i}") for i, c in enumerate(names)])
    hits = bits.agg(*[F.array(*bit_hits(F.col(c))) for c in bits.columns]).head()
    return {c: DATE_FORMATS[h.index(max(h))][0] if max(h) else None for c, h in zip(names, hits)}


def guess_format(df: DataFrame, name: str, order_by: list[str] | None = None) -> str | None:
    """The date format of a text column.

    With ``order_by`` the first non-null value decides, as a reader going down the file would
    do. Without an order the format that parses most values wins.
    """
    if order_by:
        df = df.where(col(name).isNotNull()).orderBy(*[col(c) for c in order_by]).limit(1)
    return guess_formats(df, [name])[name]


def to_timestamp(
    df: DataFrame,
    name: str,
    fmt: str | None = None,
    order_by: list[str] | None = None,
    unit: str | None = None,
) -> DataFrame:
    """Text (by a strptime format, or a guessed one) or a number of ``unit`` since 1970 to timestamp.

    One format is applied to the whole column; values of another layout become NULL.
    """
    value = col(name)
    if is_datetime(df, name):
        return replace_column(df, name, value.cast("timestamp_ntz"))
    if is_numeric(df, name):
        # Units per second.
        per_second = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
        if unit not in per_second:
            raise ValueError("a numeric column needs unit='s', 'ms', 'us' or 'ns'")
        factor = 1_000_000 / per_second[unit]
        micros = (value * factor if factor >= 1 else value / (1 / factor)).try_cast("bigint")
        return replace_column(df, name, wall_time(micros))
    if not is_text(df, name):
        raise TypeError(f"column {name!r} cannot become a date")
    chosen = fmt or guess_format(df, name, order_by)
    if chosen is None:
        raise ValueError(f"no known date format fits column {name!r}")
    return replace_column(df, name, parse_timestamp(value, chosen))


def conversion_failures(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Values a conversion turned into missing ones: nulls after minus nulls before."""
    counted = after.agg(F.count_if(col(name).isNull()).alias("n"))
    earlier = before.agg(F.count_if(col(name).isNull()).alias("n")).scalar()
    return counted.select((F.col("n") - earlier).alias("failed"))


def numeric_text_flags(df: DataFrame) -> dict[str, Column]:
    """Per text column an aggregate that is true when every non-null value is a number."""
    return {
        c: F.count(col(c)) == F.count_if(looks_numeric(col(c)))
        for c in columns_of(df, "text")
    }


def date_name(name: str) -> bool:
    # Name parts that suggest a date.
    return any(k in name.lower() for k in ("date", "time", "dt", "timestamp"))


def typed(df: DataFrame, name: str, target: str, **options) -> DataFrame:
    """Convert by the name of the target type: integer, float, string or date."""
    by_name = {"integer": to_integer, "float": to_float, "string": to_text, "date": to_timestamp}
    if target not in by_name:
        raise ValueError(f"target must be one of {sorted(by_name)}")
    return by_name[target](df, name, **options)

"""Profiles of a table: shape, missing values, duplicates, outliers, quality score, description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, columns_of, wall_micros, wall_time
from scrubline.functions.convert import (
    bit_hits, date_name, format_bits, looks_numeric, numeric_text_flags,
)
from scrubline.operators.quantiles import quantile_columns, quantile_row
from scrubline.operators.sampling import lowest_hashes

# Fixed values of the quality score.
MAX_NULL_PENALTY = 30.0
MAX_DUPLICATE_PENALTY = 20.0
NUMERIC_TEXT_PENALTY = 2.0


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of different column types."""
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len({t for _, t in df.dtypes})).cast("bigint").alias("dtypes"),
    )


def _per_column(one_row: DataFrame, entries: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def column_info(df: DataFrame) -> DataFrame:
    """Per column: non-null count and type."""
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _per_column(counts, [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("non_null"), F.lit(t).alias("dtype"))
        for i, (c, t) in enumerate(df.dtypes)])


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: null count and its share of the rows in percent."""
    counts = df.agg(F.count("*").alias("rows"),
                    *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _per_column(counts, [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"),
                 F.try_divide(F.col(f"c{i}") * 100.0, F.col("rows")).alias("null_pct"))
        for i, c in enumerate(df.columns)])


def null_cells(df: DataFrame) -> DataFrame:
    """The number of missing cells of the whole table."""
    return df.agg(sum_of([F.count_if(col(c).isNull()) for c in df.columns]).alias("null_cells"))


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


def distinct_rows(df: DataFrame, count_name: str = "__n") -> DataFrame:
    """Each different row once, with the number of its copies.

    Copies meet in the map-side aggregate first, so a row repeated a billion times does not load
    one task. Maps cannot be grouped; they are compared by their sorted entries.
    """
    keys = [F.array_sort(F.map_entries(col(f.name))).alias(f.name) if isinstance(f.dataType, T.MapType)
            else col(f.name) for f in df.schema.fields]
    return df.groupBy(*keys).agg(F.count("*").alias(count_name))


def _exact_text(value: Column, kind: T.DataType) -> Column:
    """A text that two values of a type share exactly if grouping holds them for equal; NULL for NULL."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(value == 0, F.lit("0")).otherwise(value.cast("string"))  # both zeros are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.concat(F.lit(""), *[_part(value[f.name], f.dataType) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: _part(x, kind.elementType)), "")
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_join(F.array_sort(F.transform(F.map_entries(value), lambda x: _part(x, entry))), "")
    return value.cast("string")


def _part(value: Column, kind: T.DataType) -> Column:
    """The exact text behind its length, so that parts one after the other can be read in one way only."""
    text = _exact_text(value, kind)
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(df: DataFrame) -> Column:
    """The SHA-256 of all values of a row, which stands for the row where rows are counted."""
    return F.unhex(F.sha2(F.concat(F.lit(""), *[_part(col(f.name), f.dataType) for f in df.schema.fields]), 256))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to another one in all columns, counted without their first copy; and their share.

    Only digests of 32 bytes are shuffled, whatever the width of the rows, and copies of a row meet map-side first.
    """
    n = F.col("__n")
    return df.groupBy(row_digest(df).alias("__row")).agg(F.count("*").alias("__n")).agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.try_divide(F.sum(n - 1) * 100.0, F.sum(n)), F.lit(0.0)).alias("duplicate_pct"),
    )


WORD = 60  # flags of a row in one bigint


def row_profile(df: DataFrame, dates: bool = True) -> DataFrame:
    """One row with everything the score and the issue rules need, from a scan with a shuffle of digests, and a scan of date-named texts.

    Columns: ``rows``, ``nulls`` (array in column order), ``numeric_text`` and ``date_text`` (arrays
    in text-column order; the latter NULL where the name suggests no date, or without ``dates``), ``duplicates``.
    What a row is counted for are a few bits, which go with its digest: the table is computed once for both.
    """
    texts = columns_of(df, "text")
    flags = {("null", c): col(c).isNull() for c in df.columns} | {("number", c): F.coalesce(looks_numeric(col(c)), F.lit(False)) for c in texts}
    places = {key: divmod(i, WORD) for i, key in enumerate(flags)}
    words: list[list[Column]] = [[] for _ in range(-(-len(flags) // WORD))]
    for key, flag in flags.items():
        words[places[key][0]].append(F.when(flag, F.lit(1 << places[key][1])).otherwise(F.lit(0)).cast("bigint"))
    keys = [reduce(Column.bitwiseOR, parts).alias(f"w{i}") for i, parts in enumerate(words)]
    counted = df.select(row_digest(df).alias("row"), *keys).groupBy("row", *[f"w{i}" for i in range(len(words))]).agg(F.count("*").alias("n"))

    def rows_with(kind: str, name: str) -> Column:
        word, at = places[kind, name]
        return F.coalesce(F.sum(F.when(F.col(f"w{word}").bitwiseAND(F.lit(1 << at)) != 0, F.col("n"))), F.lit(0).cast("bigint"))

    rows = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    empty = F.array().cast("array<boolean>")
    return counted.agg(
        rows.alias("rows"),
        F.array(*[rows_with("null", c) for c in df.columns]).alias("nulls"),
        (F.array(*[rows - rows_with("null", c) == rows_with("number", c) for c in texts]) if texts else empty).alias("numeric_text"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("date_text", _date_flags(df, texts) if dates and texts else F.array(*[F.lit(None).cast("boolean") for _ in texts]).cast("array<boolean>"))


def _date_flags(df: DataFrame, texts: list[str]) -> Column:
    """Per text column whether one date format fits all values; NULL where the name suggests no date. One scan."""
    named = [c for c in texts if date_name(c)]
    if not named:
        return F.array(*[F.lit(None).cast("boolean") for _ in texts])
    one = _one_format(df, named).select(F.array(*[F.col(f"c{named.index(c)}") if c in named else F.lit(None).cast("boolean") for c in texts]).alias("flags"))
    return one.scalar()


def _one_format(df: DataFrame, names: list[str]) -> DataFrame:
    """One row of c0, c1, ...: whether a column has values and one date format fits them all. The formats of a text are found once a row."""
    own = df.select(*[F.struct(col(c).alias("v"), format_bits(col(c)).alias("bits")).alias(f"c{i}") for i, c in enumerate(names)])
    return own.agg(*[((F.count(f"{x}.v") > 0) & (F.count(f"{x}.v") == F.greatest(*bit_hits(F.col(f"{x}.bits"))))).alias(x) for x in own.columns])


def _first_values(df: DataFrame, name: str, rows: int, order_by: list[str]) -> DataFrame:
    return (df.where(col(name).isNotNull()).orderBy(*[col(c) for c in order_by])
            .select(col(name).alias("v")).limit(rows))


def numeric_text_columns(
    df: DataFrame, sample_rows: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Text columns whose values all parse as numbers (columns without any value excluded).

    The whole column is tested. ``sample_rows`` with ``order_by`` tests the first values only.
    """
    texts = columns_of(df, "text")
    if not texts:
        return df.sparkSession.createDataFrame([], "`column` string")
    if sample_rows:
        tested = [_first_values(df, c, sample_rows, order_by or _no_order())
                  .agg(((F.count("v") > 0) & (F.count("v") == F.count_if(looks_numeric(F.col("v"))))).alias("ok"))
                  .select(F.lit(c).alias("column"), "ok") for c in texts]
        flags = reduce(DataFrame.unionByName, tested)
    else:
        numeric = numeric_text_flags(df)
        one = df.agg(*[((F.count(col(c)) > 0) & numeric[c]).alias(f"c{i}") for i, c in enumerate(texts)])
        flags = _per_column(one, [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("ok"))
                                  for i, c in enumerate(texts)])
    return flags.where("ok").select("column")


def date_text_columns(
    df: DataFrame, sample_rows: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Text columns with a date-like name whose values all follow one known date format."""
    named = [c for c in columns_of(df, "text") if date_name(c)]
    if not named:
        return df.sparkSession.createDataFrame([], "`column` string")
    if sample_rows:
        def fits(c: str) -> DataFrame:
            first = _first_values(df, c, sample_rows, order_by or _no_order())
            best = F.greatest(*bit_hits(F.col("bits")))
            return first.select("v", format_bits(F.col("v")).alias("bits")).agg(((F.count("v") > 0) & (F.count("v") == best)).alias("ok")).select(
                F.lit(c).alias("column"), "ok")
        flags = reduce(DataFrame.unionByName, [fits(c) for c in named])
    else:
        one = _one_format(df, named)
        flags = _per_column(one, [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("ok"))
                                  for i, c in enumerate(named)])
    return flags.where("ok").select("column")


def _no_order() -> list[str]:
    raise ValueError("a table has no row order: sample_rows needs order_by")


def fences(df: DataFrame, names: list[str], mult: float = 1.5, approx: bool = False) -> dict[str, tuple[Column, ...]]:
    """Per column: q1, q3 and the bounds beyond which a value is an outlier."""
    if not names:
        return {}
    row = quantile_row(df, {c: [0.25, 0.75] for c in names}, approx)

    def box(q: Column) -> Column:
        q1, q3 = q[0], q[1]
        reach = (q3 - q1) * mult
        return F.struct(q1.alias("q1"), q3.alias("q3"), (q1 - reach).alias("low"), (q3 + reach).alias("high"))

    # the bounds are computed inside the one-row query, so that each use is a single reference
    stats = row.select(F.struct(*[box(F.col(q)).alias(q) for q in row.columns]).alias("s")).scalar()
    return {c: tuple(stats[f"q{i}"][part] for part in ("q1", "q3", "low", "high")) for i, c in enumerate(names)}


def iqr_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: the row count and an array of outlier counts in numeric-column order."""
    names = columns_of(df, "numeric")
    bounds = fences(df, names, approx=approx)
    flags = [F.count_if((col(c) < bounds[c][2]) | (col(c) > bounds[c][3])) for c in names]
    return df.agg(F.count("*").alias("rows"),
                  (F.array(*flags) if flags else F.array().cast("array<bigint>")).alias("outliers"))


def iqr_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per numeric column: quartiles, outlier count and its share of all rows in percent."""
    names = columns_of(df, "numeric")
    bounds = fences(df, names, approx=approx)
    flags = [F.count_if((col(c) < bounds[c][2]) | (col(c) > bounds[c][3])).alias(f"c{i}")
             for i, c in enumerate(names)]
    one = df.agg(F.count("*").alias("rows"), *flags)
    return _per_column(one, [
        F.struct(F.lit(c).alias("column"), bounds[c][0].alias("q1"), bounds[c][1].alias("q3"),
                 F.col(f"c{i}").alias("outliers"),
                 F.try_divide(F.col(f"c{i}") * 100.0, F.col("rows")).alias("outlier_pct"))
        for i, c in enumerate(names)])


def score_of(rows: Column, cells_missing: Column, duplicates: Column, numeric_texts: Column, width: int) -> Column:
    """100 minus the penalties for missing cells, duplicates and numbers kept as text; 0 when empty."""
    penalty = (
        F.least(F.try_divide(cells_missing * 100.0, rows * width), F.lit(MAX_NULL_PENALTY))
        + F.least(F.try_divide(duplicates * 100.0, rows), F.lit(MAX_DUPLICATE_PENALTY))
        + numeric_texts * NUMERIC_TEXT_PENALTY
    )
    score = F.least(F.greatest(F.lit(100.0) - penalty, F.lit(0.0)), F.lit(100.0))
    return F.when(rows > 0, score).otherwise(F.lit(0.0))


def quality_score(df: DataFrame) -> DataFrame:
    """The quality score (0..100) with its parts.

    A text column without any value costs the same as one holding numbers.
    """
    one = row_profile(df, dates=False).select(
        "rows",
        F.aggregate("nulls", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("null_cells"),
        "duplicates",
        F.size(F.filter("numeric_text", lambda x: x)).cast("bigint").alias("numeric_text_columns"),
    )
    return one.select(
        "*",
        score_of(F.col("rows"), F.col("null_cells"), F.col("duplicates"),
                 F.col("numeric_text_columns"), len(df.columns)).alias("score"),
    )


def quality_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score before, score after and the improvement."""
    first = quality_score(before).select("score").scalar()
    return quality_score(after).select(
        first.alias("score_before"), F.col("score").alias("score_after"),
        (F.col("score") - first).alias("improvement"))


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows by an order key (a cheap top-n, not a full sort)."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(n)


def sample(df: DataFrame, n: int = 5, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """n random rows: the lowest hashes of the key, so partitioning cannot change the choice."""
    return lowest_hashes(df, n, key or df.columns, seed)


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: counts, most frequent text, moments and quartiles; NULL where undefined.

    Text columns give count, unique, top and freq; numeric ones mean, std and the five numbers;
    dates the same as timestamps in the ``ts_`` columns. Distinct texts of all columns are counted
    by one grouped shuffle of (column, value), which holds each different value once.
    """
    numeric = columns_of(df, "numeric")
    dates = columns_of(df, "datetime")
    micros = {c: wall_micros(col(c)) for c in dates}
    wide = df.select(*[col(c) for c in numeric], *[micros[c].alias(c) for c in dates])
    quart = quantile_columns(wide, {c: [0.25, 0.5, 0.75] for c in numeric + dates})
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(df.columns):
        if c in numeric or c in dates:
            value = col(c) if c in numeric else micros[c]
            aggs += [F.avg(value).alias(f"avg{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
                     F.stddev_samp(value).alias(f"std{i}")]
    one = df.agg(*aggs)

    def number(i: int, c: str, part: str) -> Column:
        return F.col(f"{part}{i}").cast("double") if c in numeric else F.lit(None).cast("double")

    def moment(c: str, micro: Column) -> Column:
        exact = wall_time(F.floor(micro).cast("bigint"))
        return exact if c in dates else F.lit(None).cast("timestamp_ntz")

    def quartile(c: str, j: int) -> Column:
        return quart[c][j] if c in numeric else F.lit(None).cast("double")

    entries = []
    for i, c in enumerate(df.columns):
        entries.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
            number(i, c, "avg").alias("mean"), number(i, c, "std").alias("std"),
            number(i, c, "min").alias("min"), quartile(c, 0).alias("q25"), quartile(c, 1).alias("q50"),
            quartile(c, 2).alias("q75"), number(i, c, "max").alias("max"),
            moment(c, F.col(f"avg{i}") if c in dates else F.lit(0)).alias("ts_mean"),
            moment(c, F.col(f"min{i}") if c in dates else F.lit(0)).alias("ts_min"),
            moment(c, quart[c][0] if c in dates else F.lit(0)).alias("ts_25"),
            moment(c, quart[c][1] if c in dates else F.lit(0)).alias("ts_50"),
            moment(c, quart[c][2] if c in dates else F.lit(0)).alias("ts_75"),
            moment(c, F.col(f"max{i}") if c in dates else F.lit(0)).alias("ts_max"),
        ))
    stats = _per_column(one, entries)
    others = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    if not others:
        return stats.withColumns({"unique": F.lit(None).cast("bigint"), "top": F.lit(None).cast("string"),
                                  "freq": F.lit(None).cast("bigint")})
    melted = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in others])).alias("x"))
    tops = (
        melted.where(F.col("x.value").isNotNull())
        .groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
        .groupBy("column").agg(F.count("*").alias("unique"),
                               F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("t"))
        .select("column", "unique", F.col("t.value").alias("top"), (-F.col("t.n")).alias("freq"))
    )
    return stats.join(tops, "column", "left")

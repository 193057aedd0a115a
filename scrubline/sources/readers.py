"""Reading CSV and JSON files into typed tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, normalize_missing, wall_time
from scrubline.functions.convert import BLANKS, parse_number, parse_timestamp
from scrubline.session import cut_lineage

# Texts a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts of a boolean column.
TRUE_WORDS, FALSE_WORDS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
INTEGER = r"^\s*[+-]?\d+\s*$"
ISO_FORMATS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f"]


def unique_names(header: list[str | None]) -> list[str]:
    """Repeated names become ``a``, ``a.1``, ``a.2``; a missing one ``Unnamed: position``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(header):
        base = name if name not in (None, "") else f"Unnamed: {i}"
        candidate = base
        while candidate in out:
            seen[base] = seen.get(base, 0) + 1
            candidate = f"{base}.{seen[base]}"
        out.append(candidate)
    return out


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether a record spans lines: some line then holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files whose quoted values may hold line breaks: (header, record), the header being a file's first record.

    Files are read in ranges of lines, each by any task. A record ends at a line behind which the number of quotes so far is even. A first scan
    counts the quotes of every range; carried on from range to range, they say whether a range begins inside a record, and in which range that
    record began. A second scan joins the lines of records; only parts of records that cross a border between ranges are shuffled.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    # a carriage return at the end of a line is part of a value's line break, but not of a record
    lines = spark.read.text(path, lineSep="\n").select(*meta, "value")
    counted = sorted(lines.mapInArrow(_count_quotes, "file string, start bigint, quotes bigint, turns boolean").collect(), key=lambda r: (r["file"], r["start"]))
    borders: dict[tuple[str, int], tuple[int, int]] = {}  # per range: whether it begins inside a record, and the range where that one began
    before, origin, file = 0, 0, None
    for r in counted:
        if r["file"] != file:
            file, before, origin = r["file"], 0, r["start"]
        borders[(r["file"], r["start"])] = before, origin
        after = (before + r["quotes"]) % 2
        if after and (not before or r["turns"]):
            origin = r["start"]
        before = after
    shared = spark.sparkContext.broadcast(borders)  # a few numbers a range

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, inside, origin, begun = [], None, 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for key, own in _by_range(batch):
                if key != now:
                    if held:
                        out.append((now[0], origin, now[1], begun, False, "\n".join(held)))
                    now, held, begun = key, [], False
                    inside, origin = shared.value[key]
                    crosses, first = bool(inside), key[1] == 0 and not inside
                texts = own.to_pylist()
                odd = np.asarray(pc.count_substring(own, '"')) % 2
                for text, ends in zip(texts, (inside + np.cumsum(odd)) % 2 == 0):
                    if not held and not crosses:
                        begun, origin = first, now[1]
                        first = False
                    held.append(text)
                    if ends:
                        out.append((now[0], origin, now[1], begun, not crosses, "\n".join(held)))
                        held, crosses, begun = [], False, False
                inside = int((inside + odd.sum()) % 2)
            yield _table(out)
        if held:
            yield _table([(now[0], origin, now[1], begun, False, "\n".join(held))])

    parts = lines.mapInArrow(join, "file string, origin bigint, start bigint, header boolean, whole boolean, record string")
    crossing = parts.where("not whole").groupBy("file", "origin").agg(
        F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"))
    records = parts.where("whole").select("header", "record").unionByName(crossing.select("header", "record"))
    return records.withColumn("record", F.regexp_replace("record", "\\r$", "")).where("header or trim(record) <> ''")


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each range of a batch; a range's lines lie together and in order."""
    files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    change = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files.indices.to_numpy()) != 0)) + 1
    for a, b in zip([0, *change], [*change, batch.num_rows]):
        if b > a:
            yield (batch.column("file")[int(a)].as_py(), int(starts[a])), batch.column("value")[int(a) : int(b)]


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its quotes, and whether behind some line their number so far is odd."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for key, own in _by_range(batch):
            entry = found.setdefault(key, [0, False])
            upto = entry[0] + np.cumsum(np.asarray(pc.count_substring(own, '"')))
            entry[0], entry[1] = int(upto[-1]), entry[1] or bool((upto % 2).any())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                                      pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.bool_())],
                                     names=["file", "start", "quotes", "turns"])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "origin", "start", "header", "whole", "record"])


def infer_columns(df: DataFrame) -> DataFrame:
    """Text columns to integers, numbers or booleans where all their values allow it.

    One aggregate over all columns decides; only its single row comes to the driver.
    """
    tests = []
    for i, c in enumerate(df.columns):
        v = col(c)
        tests += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(INTEGER) & F.btrim(v, F.lit(BLANKS)).try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count(parse_number(v)).alias(f"f{i}"),
            F.count_if(v.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{i}"),
        ]
    found = df.agg(*tests).head()
    out: list[Column] = []
    for i, c in enumerate(df.columns):
        n, v = found[f"n{i}"], col(c)
        if n and found[f"i{i}"] == n:
            v = F.btrim(v, F.lit(BLANKS)).try_cast("bigint")
        elif n == 0 or found[f"f{i}"] == n:
            v = parse_number(v)
        elif found[f"b{i}"] == n:
            v = v.isin(TRUE_WORDS)
        out.append(v.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None, infer: bool = True) -> DataFrame:
    """A CSV file or folder with a header line.

    Missing-value words become NULL, types are inferred from all rows, dates stay text, and a
    column without any value is a number column. A line with too few fields is filled up with NULL;
    one with more fields than the header fails the read, and so does a file of the folder whose header
    is another one. A file is split over tasks whether or not quoted values hold line breaks; ``multi_line``
    states that they do instead of looking.
    """
    if multi_line is None:
        multi_line = has_quoted_newlines(spark, path)
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if multi_line:
        records = csv_records(spark, path)
        headers = [r["record"] for r in records.where("header").select("record").distinct().limit(2).collect()]
        if len(headers) > 1:
            raise ValueError(f"{path} holds files with different headers")
        first = _fields(spark, headers[0], options) if headers else None
    else:
        first = spark.read.option("quote", '"').option("escape", '"').option("header", False).option("inferSchema", False).csv(path).head()
    if first is None:
        raise ValueError(f"{path} holds no columns")
    names = unique_names(list(first))
    bad = "_line_" + "_".join(names)[:40]  # holds a line whose number of fields is not the header's
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    if multi_line:
        parsed = F.from_csv("record", _ddl(schema), options | {"columnNameOfCorruptRecord": bad})
        raw = records.where("not header").select(parsed.alias("r")).select("r.*")
    else:
        raw = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", names != [x or "" for x in first])
            .option("columnNameOfCorruptRecord", bad).option("columnPruning", False).options(**options).csv(path)
        )
    bare = F.regexp_replace(col(bad), '"[^"]*"', "")
    too_long = F.length(F.regexp_replace(bare, "[^,]", "")) >= len(names)
    complaint = F.concat(F.lit(f"more than {len(names)} fields: "), F.left(col(bad), F.lit(200)))
    texts = raw.select(*[F.when(too_long, F.raise_error(complaint).cast("string")).when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in names])
    return infer_columns(texts) if infer else texts


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def _fields(spark: SparkSession, record: str, options: dict[str, str]) -> list[str | None]:
    """The fields of a header, which are as many as it has commas outside quotes, and one."""
    width = re.sub('"[^"]*"', "", record).count(",") + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    return list(spark.range(1).select(F.from_csv(F.lit(record), schema, options).alias("r")).select("r.*").head())


def date_label(name: str) -> bool:
    """Column names a JSON reader takes for dates."""
    # The names and name parts.
    low = name.lower()
    return low.endswith(("_at", "_time")) or low.startswith("timestamp") or low in ("modified", "date")


def _json_dates(df: DataFrame) -> DataFrame:
    """Date-named columns to timestamps where every value allows it."""
    named = [f for f in df.schema.fields if date_label(f.name)
             and isinstance(f.dataType, (T.StringType, T.LongType, T.DoubleType))]
    if not named:
        return df
    ways: dict[str, list[Column]] = {}
    for f in named:
        v = col(f.name)
        if isinstance(f.dataType, T.StringType):
            ways[f.name] = [parse_timestamp(v, x) for x in ISO_FORMATS]
            continue
        # numbers count from 1970 in the first unit that keeps all of them inside 1971..2262
        units = [("s", 1_000_000.0), ("ms", 1_000.0), ("us", 1.0), ("ns", 0.001)]  # fixed values
        first_year, last = 31_536_000 * 1_000_000, 9_223_372_036 * 1_000_000
        ways[f.name] = [
            F.when((v * m > first_year) & (v * m < last), wall_time((v * m).try_cast("bigint")))
            for _, m in units]
    checks = [F.count(w).alias(f"{i}_{j}") for i, f in enumerate(named) for j, w in enumerate(ways[f.name])]
    counts = df.agg(*[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(named)], *checks).head()
    chosen = {}
    for i, f in enumerate(named):
        for j, way in enumerate(ways[f.name]):
            if counts[f"n{i}"] and counts[f"{i}_{j}"] == counts[f"n{i}"]:
                chosen[f.name] = way
                break
    return df.select(*[chosen.get(c, col(c)).alias(c) for c in df.columns])


def read_json(spark: SparkSession, path: str, lines: bool | None = None, convert_dates: bool = True) -> DataFrame:
    """JSON records (an array or one per line) or an object of columns, as a table.

    An array or an object is one JSON value, which no reader can split: many large files are read
    in parallel, one large file is not. Records per line split anywhere. ``lines`` states the
    layout instead of looking at the first character.
    """
    first = spark.read.text(path).where(F.trim("value") != "").head()
    if first is None:
        raise ValueError(f"{path} is empty")
    start = first["value"].strip()
    columns = start.startswith("{") and lines is not True and _is_column_object(spark, path)
    if columns:
        df = _columns_to_rows(spark, path)
    else:
        if lines is None:
            lines = start.startswith("{") and start.endswith("}")
        df = spark.read.option("multiLine", not lines).json(path)
    df = normalize_missing(df)
    return _json_dates(df) if convert_dates else df


def _members(spark: SparkSession, path: str) -> DataFrame:
    """The members (name, value) of the JSON object of each file, values not looked into."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,variant>")).alias("name", "value"))


def _cells(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _is_column_object(spark: SparkSession, path: str) -> bool:
    """An object of columns: one JSON object, of which every member is an object keyed by row labels."""
    second = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    if len(second) > 1 and second[0]["value"].strip().endswith("}"):
        return False  # records, one a line
    found = _members(spark, path).agg(F.count("*").alias("n"), F.count(_cells(F.col("value"))).alias("columns")).head()
    return found["n"] > 0 and found["n"] == found["columns"]


def _columns_to_rows(spark: SparkSession, path: str) -> DataFrame:
    """Turn ``{column: {row: value}}`` into rows. Row labels are data from the first scan on: no schema holds them."""
    cells = cut_lineage(_members(spark, path).select("name", F.explode(_cells(F.col("value"))).alias("row", "v")))
    kinds = {r["name"]: _plain_type(r["kind"]) for r in cells.groupBy("name").agg(F.schema_of_variant_agg("v").alias("kind")).collect()}
    places = _members(spark, path).select("name", F.monotonically_increasing_id().alias("at")).groupBy("name").agg(F.min("at").alias("at"))
    names = [r["name"] for r in places.orderBy("at").collect() if r["name"] in kinds]
    grouped = cells.groupBy("row").agg(*[F.max(F.when(F.col("name") == c, F.try_variant_get("v", "$", kinds[c]))).alias(c) for c in names])
    return grouped.orderBy(F.col("row").try_cast("bigint"), "row").select(*[col(n) for n in names])


def _plain_type(kind: str) -> str:
    """The type of a column from the common type of its cells; what has none becomes text."""
    if kind in ("VOID", "VARIANT"):
        return "string"
    return re.sub(r"DECIMAL\(\d+,\d+\)|FLOAT", "DOUBLE", kind).replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")


def load_tables(spark: SparkSession, paths: dict[str, str] | list[str], on_error=None) -> dict[str, DataFrame]:
    """Several files as named tables, the reader chosen by extension.

    An unreadable file raises, or is passed to ``on_error(name, error)`` and skipped.
    """
    named = paths if isinstance(paths, dict) else {p.rstrip("/").rsplit("/", 1)[-1]: p for p in paths}
    tables = {}
    for name, path in named.items():
        try:
            low = path.rstrip("/").lower()
            if low.endswith(".csv"):
                tables[name] = read_csv(spark, path)
            elif low.endswith(".json"):
                tables[name] = read_json(spark, path)
            elif low.endswith(".parquet"):
                tables[name] = normalize_missing(spark.read.parquet(path))
            else:
                raise ValueError(f"{path}: the extension must be .csv, .json or .parquet")
        except Exception as error:
            if on_error is None:
                raise
            on_error(name, error)
    return tables


def row_guard(df: DataFrame, max_rows: int) -> DataFrame:
    """Reject a table of more rows than allowed; counting stops one row beyond the limit."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the table has more than {max_rows:,} rows")
    return df

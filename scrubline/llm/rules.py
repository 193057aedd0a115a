"""Quality rules whose cutoffs follow the data.

Every text is measured in one pass over its words and lines. Per language and source, and per measure, a mergeable
quantile sketch is kept: counts by value, where of a value above 63 only the six highest bits count, so quantiles are off by less
than 1/64 and two sketches merge by adding counts, in any order, with equal results. The quartiles of the sketches give
the fences that replace fixed cutoffs: a text goes if a measure is further above the upper quartile than SPREAD
times the interquartile range and a small slack. Every group has its own fences, at any size: to its counts are added the shares of
its language and of all texts, each with the weight of STEADY texts, so a group of a few texts is steadied and a large one is
hardly moved, without a size at which the rule changes. Weights are whole numbers, equal under any partitioning.

Defined results: a null text has no words; texts that fail the base rules take no part in sketches and are not kept; null languages and
sources form groups like any other value; other columns stay, those named like an output are replaced; a frame without
rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

SYMBOLS = b"#*$%&|<>"  # fixed value
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SPREAD = 3
STEADY = 8  # texts
UNIT = 1 << 16  # weight of a text
# Measures, all whole numbers: how they come from the counts, the slack, and whether low values are outliers too.
MEASURES: dict[str, tuple[str, int, bool]] = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 100, False),  # per 1,000 words
    "dup_lines": ("1000 * greatest(n_dup_lines - 1, 0) div greatest(n_lines, 1)", 300, False),  # per 1,000 lines, the first free
    "repeats": ("1000 * greatest(n_repeat_words - 30, 0) div greatest(n_words, 1)", 300, False),  # per 1,000 words, a repeated line's worth free
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 100, True),  # hundredths of a character
}


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index = dict(zip(dict.fromkeys(words), range(n)))
    ids, v = np.fromiter(map(index.__getitem__, words), np.int64, n), len(index)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def count_text(text: str) -> tuple[int, ...]:
    """The values of COUNTS."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of a text and whether it fails the base rules."""
    @F.arrow_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def text_counts(texts: pa.Array) -> pa.Array:
        rows = [count_text(x or "") for part in slices(texts) for x in part.to_pylist()]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], COUNTS)

    counted = df.withColumn("_counts", text_counts(F.col(text)))
    out = counted.withColumns({c: F.col(f"_counts.{c}") for c in COUNTS}).drop("_counts")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def sketch_bucket(value: Column) -> Column:
    """The lowest value with the same six highest bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("bigint")
    return value - value % step


def share(counts: DataFrame, of: list[str]) -> DataFrame:
    """The counts by bucket of a larger group as weights that add up to STEADY texts, whatever its size."""
    total = F.sum("n").over(Window.partitionBy(*of))
    return counts.select(*of, "bucket", "n", total.alias("total")).select(*of, "bucket", F.expr(f"n * {STEADY * UNIT} div total").alias("weight"))


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per language and source, the lowest and highest value each measure may have."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.expr(sql).alias("value")) for m, (sql, _, _) in MEASURES.items()))
    each = (measured.where("not base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(values).alias("m"))
            .groupBy("lang", "source", F.col("m.measure").alias("measure"), sketch_bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n")))
    # languages and all texts, as shares that weigh STEADY texts together with the group's own counts
    by_lang = each.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    groups = each.select("lang", "source").distinct()
    own_lang = groups.alias("g").join(share(by_lang, ["lang", "measure"]).alias("s"), F.col("g.lang").eqNullSafe(F.col("s.lang"))).select("g.lang", "source", "measure", "bucket", "weight")
    merged = (each.select("lang", "source", "measure", "bucket", (F.col("n") * UNIT).alias("weight")).unionByName(own_lang)
              .unionByName(groups.crossJoin(share(whole, ["measure"])).select("lang", "source", "measure", "bucket", "weight"))
              .groupBy("lang", "source", "measure", "bucket").agg(F.sum("weight").alias("n")))
    own = Window.partitionBy("lang", "source", "measure")  # a few hundred buckets at most
    ranked = merged.withColumns({"upto": F.sum("n").over(own.orderBy("bucket")), "total": F.sum("n").over(own)})

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))

    q = ranked.groupBy("lang", "source", "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    bounds = []
    for m, (_, slack, low) in MEASURES.items():
        reach = (F.col("q3") - F.col("q1")) * SPREAD + slack
        own_row = F.col("measure") == m
        bounds.append(F.max(F.when(own_row, F.col("q3") + reach)).alias(f"{m}_high"))
        bounds.append((F.max(F.when(own_row, F.col("q1") - reach)) if low else F.lit(0).cast("bigint")).alias(f"{m}_low"))
    names = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    return (q.groupBy("lang", "source").agg(*bounds)
            .select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), F.struct(*names).alias("fence")))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``kept``. Joined on language and source; the fences are a row per group, so Spark can send them to all."""
    inside = [F.col("fence").isNotNull()]
    for m, (sql, _, _) in MEASURES.items():
        inside.append(F.expr(f"({sql}) between fence.{m}_low and fence.{m}_high"))
    ok = ~F.col("base_failed")
    for x in inside:
        ok = ok & F.coalesce(x, F.lit(False))
    on = F.col(lang).eqNullSafe(F.col("fence_lang")) & F.col(source).eqNullSafe(F.col("fence_source"))
    return measured.join(limits, on, "left").withColumn("kept", ok).drop("fence_lang", "fence_source", "fence")


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed and kept for every row, with the columns of ``keep``; the text itself is not carried along."""
    own = df.select(*keep, F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    measured = materialize(measure(own, "_text").drop("_text"), "measured")
    return judge(measured, materialize(fences(measured, "_lang", "_source"), "fences"), "_lang", "_source").drop("_lang", "_source")

"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target, a share of all words by its weight, of at most CAP times its own words; what
sources cannot take goes to the others by weight. A source's target gives every document an expected number of copies. Its whole
part is certain. For the fraction f, a document draws U from its id and has the rank Q = (U / (1 - U)) / (f / (1 - f)),
its random odds by its inclusion odds; the documents of lowest rank are taken until their words reach what is
left of the target. With a ``weight`` column, documents of a source have unequal expected copies, in proportion to it.

No source is gathered or sorted in one task: the last document taken is found by two rounds of counting words in BINS
bins of the rank, and only the documents of the last bin, about a millionth of the source, are ordered. Draws come from ids,
so reruns agree. The table of sources (a row each) is the only thing ordered as a whole.

Defined results: a null text has no words; a null source is a source, ordered last; null weights and those not above zero
count as none (no copies); rows with equal id and size share their fate; a source without words has target 0; other columns are untouched;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fraction, materialize

CAP = 3
BINS = 1024
WEIGHTS = (5, 2, 1)
LOWEST = -(1 << 63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """source, source_size, target, from rows (source, size).

    Sources in code point order take the weights in turn. Water is poured by weight: sources that are full, those with
    the least room for their weight first, leave the rest to the others.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    named = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("bigint"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    poured = named.withColumns({
        "left": F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
        "among": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("open", F.col("source_size") * cap * F.col("among") > F.col("weight") * F.col("left"))
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    level = poured.withColumn("level", F.first(F.when(F.col("open"), F.struct("left", "among")), ignorenulls=True).over(first))
    target = F.when(F.col("level").isNull(), (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.among"))
    return level.select("source", "source_size", F.least(target, (F.col("source_size") * cap).cast("double")).alias("target"))


def _draws(df: DataFrame, key: str, source: str, size: Column, weight: str | None, seed: str) -> DataFrame:
    """df with the columns the decision needs: source, size, weight, draw, order key, all under names starting with _m."""
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(0.0)
    return df.withColumns({"_m_source": F.col(source), "_m_size": size, "_m_weight": w, "_m_draw": fraction(F.lit(seed), F.col(key)),
                           "_m_key": F.coalesce(F.col(key).cast("bigint"), F.lit(LOWEST))})


def _expected(scale: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.col("_m_weight") * scale)


def _whole(scale: Column, cap: int) -> Column:
    return F.floor(_expected(scale, cap))


def _rank(scale: Column, cap: int) -> Column:
    """Q / (1 + Q), which orders like Q and lies in (0, 1); null where no copy is left to chance."""
    f = _expected(scale, cap) - _whole(scale, cap)
    q = (F.col("_m_draw") / (1 - F.col("_m_draw"))) / (f / (1 - f))
    return F.when((f > 0) & (f < 1), q / (1 + q))


def _scales(rows: DataFrame, goals: DataFrame, cap: int, weighted: bool) -> DataFrame:
    """Per source, the factor from weight to expected copies that meets the target although no document passes the cap.

    Documents at the cap are set aside and the factor is raised for the others until none joins them.
    """
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target")
    if not weighted:
        return goals.withColumn("scale", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    scales = goals.withColumns({"scale": F.lit(0.0), "capped": F.lit(-1).cast("bigint")})
    while True:
        at_cap = (F.col("_m_weight") * F.col("scale") >= cap) & (F.col("_m_weight") > 0)
        mass = F.col("_m_size") * F.col("_m_weight")
        sums = (rows.join(scales, F.col("_m_source").eqNullSafe(F.col("_s"))).groupBy(F.col("_m_source").alias("source"))
                .agg(F.sum(F.when(at_cap, F.col("_m_size")).otherwise(0)).alias("full"), F.sum(F.when(at_cap, 0.0).otherwise(mass)).alias("mass"),
                     F.count(F.when(at_cap, 1)).alias("capped")))
        fresh = sums.join(goals, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
            "scale", F.when(F.col("mass") > 0, F.greatest(F.col("target") - F.col("full") * cap, F.lit(0.0)) / F.col("mass")).otherwise(float(cap) * (1 << 40)))
        fresh = materialize(fresh.select("_s", "source_size", "target", "scale", "capped"), "scales")
        changed = fresh.alias("a").join(scales.alias("b"), F.expr("a._s <=> b._s")).where("a.capped <> b.capped and a.capped > 0").limit(1).count()
        scales = fresh
        if not changed:
            return scales.drop("capped")


def source_plan(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weight: str | None = None,
                weights: Sequence[int] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """A row per source: source, source_size, target, scale, and the rank, key and size of the last document taken by chance."""
    rows = _draws(df, key, source, word_count(F.col(text)), weight, seed).select("_m_source", "_m_size", "_m_weight", "_m_draw", "_m_key")
    rows = materialize(rows, "draws")
    goals = materialize(targets(rows.select(F.col("_m_source").alias("source"), F.col("_m_size").alias("size")), weights, share, cap), "targets")
    scales = _scales(rows, goals, cap, weight is not None)
    known = rows.join(scales, F.col("_m_source").eqNullSafe(F.col("_s")))
    certain = known.groupBy(F.col("_s").alias("_c")).agg(F.sum(F.col("_m_size") * _whole(F.col("scale"), cap)).alias("certain"))
    left = materialize(scales.join(certain, F.col("_s").eqNullSafe(F.col("_c")), "left").select(
        "_s", "source_size", "target", "scale", (F.col("target") - F.coalesce("certain", F.lit(0))).alias("left")), "left")
    ranked = (rows.join(left.where("left > 0"), F.col("_m_source").eqNullSafe(F.col("_s")))
              .withColumn("rank", _rank(F.col("scale"), cap)).where("rank is not null").select("_s", "left", "rank", "_m_key", "_m_size"))
    for k in (1, 2):  # narrow to the bin, then to the bin of the bin, in which the sum of words reaches what is left
        cell = F.floor(F.col("rank") * float(BINS ** k))
        sums = ranked.groupBy("_s", "left", cell.alias("cell")).agg(F.sum("_m_size").alias("words"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("_s").orderBy("cell")))  # BINS rows at most
        last = F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), F.struct("cell", "upto", "words"))), F.max(F.struct("cell", "upto", "words")))
        edge = materialize(upto.groupBy(F.col("_s").alias("_e")).agg(last.alias("e")).select(
            "_e", F.col("e.cell").alias("cell"), (F.col("e.upto") - F.col("e.words")).alias("below")), "edge")
        ranked = (ranked.join(edge, F.col("_s").eqNullSafe(F.col("_e")) & (cell == F.col("cell")))
                  .select("_s", (F.col("left") - F.col("below")).alias("left"), "rank", "_m_key", "_m_size"))
    fates = ranked.groupBy("_s", "left", "rank", "_m_key", "_m_size").agg(F.sum("_m_size").alias("words"))
    order = Window.partitionBy("_s").orderBy("rank", "_m_key", "_m_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = fates.withColumn("upto", F.sum("words").over(order))
    # the document that crosses the line is taken if this ends nearer to it
    taken = sums.where(F.col("upto") + (F.col("upto") - F.col("words")) <= 2 * F.col("left"))
    place = F.struct(F.col("rank").alias("rank"), F.col("_m_key").alias("key"), F.col("_m_size").alias("size"))
    found = taken.groupBy(F.col("_s").alias("_t")).agg(F.max(place).alias("last"))
    # where not even the first of the last bin is taken, all of lower bins are
    floors = ranked.groupBy(F.col("_s").alias("_r")).agg(F.min("rank").alias("rank"))
    none = F.struct(F.col("rank").alias("rank"), F.lit(LOWEST).alias("key"), F.lit(-1).cast("bigint").alias("size"))
    return materialize(left.join(floors, F.col("_s").eqNullSafe(F.col("_r")), "left").join(found, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
        F.col("_s").alias("plan_source"), "source_size", "target", "scale", F.coalesce(F.col("last"), F.when(F.col("rank").isNotNull(), none)).alias("last")), "plan")


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weight: str | None = None, size: str = "size",
                copies: str = "copies", weights: Sequence[int] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """Add to every row its size in words, its source's source_size and target, and its number of copies in the mix.

    A row's fate follows from its own values and its source's row of the plan, which Spark joins as it sees fit
    (the plan is a written table, so its size is known).
    """
    plan = source_plan(df, key, source, text, weight, weights, share, cap, seed)
    drawn = _draws(df, key, source, word_count(F.col(text)), weight, seed)
    rank = _rank(F.col("scale"), cap)
    own = F.struct(rank.alias("rank"), F.col("_m_key").alias("key"), F.col("_m_size").alias("size"))
    chance = F.coalesce(own <= F.col("last"), F.lit(False)) & rank.isNotNull()
    out = drawn.drop(size, copies, "source_size", "target").join(plan, F.col("_m_source").eqNullSafe(F.col("plan_source")))
    number = (_whole(F.col("scale"), cap) + chance.cast("int")).cast("int")
    return (out.withColumns({size: F.col("_m_size"), copies: F.when(F.col("_m_size") > 0, number).otherwise(0)})
            .drop("plan_source", "scale", "last", "_m_source", "_m_size", "_m_weight", "_m_draw", "_m_key"))

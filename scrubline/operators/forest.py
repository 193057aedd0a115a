"""Quick prediction: a random forest on chosen columns, its scores and feature importances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scrubline.functions.classes import col, dtype, is_numeric, is_text
from scrubline.operators import trees as trees_of
from scrubline.operators.sampling import key_hash, lowest_hashes
from scrubline.session import cut_lineage

# Fixed values of the training set-up.
CLASS_LIMIT = 15
MIN_ROWS = 30
TREES = 60
SEED = 42
TOP_FEATURES = 15
MAX_CATEGORIES = 10_000
MAX_DEPTH = 30  # the library's greatest depth
TEST_SHARE = 0.2
SUBTREE_ROWS = 1_000_000  # training rows, or cells of rows in equal bins, of which one task grows a tree or subtree
CELL_ROWS = 4  # rows a cell on average from which trees are grown over cells
FEW_DRAWS = 2_000  # different random numbers of which a tree's sample might hold none
BLOCK = 1 << 17  # rows that are added up at a time
HELD = 1 << 23  # sums a task hands on at once


def problem_stats(df: DataFrame, target: str) -> DataFrame:
    """Distinct values of the target and the problem it poses: regression or classification."""
    numeric = is_numeric(df, target, with_bool=True)
    # a grouped count: copies are removed map-side, no task holds all distinct values
    return (
        df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("distinct_values"))
        .select("distinct_values",
                F.when(F.lit(numeric) & (F.col("distinct_values") > CLASS_LIMIT), "regression")
                .otherwise("classification").alias("problem"))
    )


def infer_problem(df: DataFrame, target: str) -> str:
    return problem_stats(df, target).head()["problem"]


def prepare_training(
    df: DataFrame, features: list[str], target: str, key: list[str] | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Rows complete in features and target; ``max_rows`` takes a seeded random sample of them."""
    names = list(dict.fromkeys([*(key or []), *features, target]))
    for c in names:
        dtype(df, c)
    if target in features:
        raise ValueError("the target cannot be a feature")
    if not features:
        raise ValueError("at least one feature is needed")
    rows = df.select(*[col(c) for c in names])
    for c in [*features, target]:
        rows = rows.where(col(c).isNotNull())
    if max_rows is not None:
        if not key:
            raise ValueError("max_rows needs a key to draw by")
        rows = lowest_hashes(rows, max_rows, key, SEED)
    return rows


def split(df: DataFrame, key: list[str], test_share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and test part by a hash of the key, the same under any partitioning."""
    bucket = F.pmod(key_hash(key, seed), F.lit(10_000))
    cut = int(test_share * 10_000)
    return df.where(bucket >= cut), df.where(bucket < cut)


def one_hot(df: DataFrame, features: list[str], max_columns: int | None = None) -> list[tuple[str, Column]]:
    """The feature columns as numbers, in order: a text feature gives one column per value.

    The first value in sorted order gets no column. ``max_columns`` keeps only the first columns;
    without it a text feature of very many values is refused, since the model would need a
    column for each.
    """
    out: list[tuple[str, Column]] = []
    for c in features:
        if not is_text(df, c):
            out.append((c, col(c).cast("double")))
            continue
        room = MAX_CATEGORIES if max_columns is None else max(max_columns - len(out), 0) + 1
        values = df.groupBy(col(c).alias("v")).agg(F.count("*")).select("v").where("v is not null").orderBy("v").limit(room + 1)
        values = [r["v"] for r in values.collect()]
        if max_columns is None and len(values) > MAX_CATEGORIES:
            raise ValueError(f"column {c!r} has over {MAX_CATEGORIES} values; give max_columns")
        out += [(f"{c}_{v}", F.when(col(c) == v, 1.0).otherwise(0.0)) for v in values[1:]]
    return out[:max_columns]


def indicators(df: DataFrame, features: list[str], max_columns: int | None = None) -> tuple[list, list[str], list[tuple[str, str | None]]]:
    """What ``one_hot`` gives, as sparse vectors: fitted stages, the columns to assemble, and (feature, value) for each of their parts.

    A text feature may have any number of values; they become the labels of a stage, which the model holds anyway.
    """
    stages, inputs, names = [], [], []
    for i, c in enumerate(features):
        room = None if max_columns is None else max_columns - len(names)
        if room is not None and room <= 0:
            break
        if not is_text(df, c):
            inputs.append(c)
            names.append((c, None))
            continue
        values = df.groupBy(col(c).alias("v")).agg(F.count("*")).select("v").where("v is not null").orderBy("v")
        values = [r["v"] for r in (values if room is None else values.limit(room + 1)).collect()][1:]
        if values:
            # the first value and those without room get the last number, which has no column
            index = StringIndexerModel.from_labels(values, inputCol=c, outputCol=f"__i{i}", handleInvalid="keep")
            encoder = OneHotEncoder(inputCol=f"__i{i}", outputCol=f"__v{i}", dropLast=True).fit(index.transform(df.limit(0)))
            stages += [index, encoder]
            inputs.append(f"__v{i}")
            names += [(c, v) for v in values]
    return stages, inputs, names


@dataclass
class Training:
    """A fitted forest's predictions on the test part, and what its splits were worth."""

    problem: str
    importances: list[float]  # of feature_names, adding up to 1
    feature_names: list[str]
    predictions: DataFrame  # key columns, actual, predicted
    classes: int | None
    depths: list[int] | None = None  # levels grown in the tasks, per tree
    top: PipelineModel | None = None  # the levels above them, where rows were too many for a task


def train_forest(
    df: DataFrame, features: list[str], target: str, key: list[str], max_rows: int | None = None,
    max_columns: int | None = None, trees: int = TREES, depth: int = MAX_DEPTH, seed: int = SEED, max_bins: int = 64,
    subtree_rows: int = SUBTREE_ROWS,
) -> Training:
    """Fit a random forest on 80 % of the rows and predict the rest.

    The problem follows from the target (see ``problem_stats``). Regression looks at all features
    in each split, classification at their square root. Trees grow until ``depth``. Rows in equal bins of all features (a cell) can never
    be split, so where cells are far fewer than rows, and at most ``subtree_rows``, each task adds up its rows by cell and tree, and trees are grown over the sums. Else, up to ``subtree_rows`` training rows a
    task grows a tree whole; of more, the library grows levels over all rows until few enough share a node, and tasks grow the
    subtrees below. A numeric feature is split at no more than ``max_bins`` - 1 places, which a quantile sketch
    of all rows gives; one of up to ``max_bins`` values is split between any two. Samples are drawn by a hash of the key, so results
    do not depend on partitions while tasks grow whole trees.
    """
    rows = prepare_training(df, features, target, key, max_rows)
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed")
    stats = problem_stats(rows, target).head()
    problem = stats["problem"]
    if problem == "classification" and stats["distinct_values"] > MAX_CATEGORIES:
        raise ValueError(f"column {target!r} has over {MAX_CATEGORIES} classes")
    rows = rows.withColumn("__label", col(target).cast("double" if problem == "regression" else "string"))
    for c in features:
        if dtype(df, c).simpleString() == "boolean":
            rows = rows.withColumn(c, col(c).cast("int"))
    # positional names: a feature's own name may clash with those of the stages
    plain = [col(c) if is_text(rows, c) else col(c).cast("double") for c in features]
    tested = F.pmod(key_hash(key, seed), F.lit(10_000)) < int(TEST_SHARE * 10_000)
    # written once: all that follows reads these rows, not the source
    encoded = cut_lineage(rows.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__label", *[x.alias(f"__f{i}") for i, x in enumerate(plain)],
        tested.alias("__test"), key_hash(key, seed + 1).cast("bigint").alias("__draw")).withColumn("__id", F.monotonically_increasing_id()))
    stages, inputs, names = indicators(encoded, [f"__f{i}" for i in range(len(features))], max_columns)
    named = {f"__f{i}": c for i, c in enumerate(features)}
    used = list(dict.fromkeys(c for c, _ in names))
    labels = None
    if problem == "classification":
        labels = [r["v"] for r in encoded.groupBy(F.col("__label").alias("v")).agg(F.count("*")).select("v").orderBy("v").collect()]
    places = _split_places(encoded, [c for c, v in names if v is None], max_bins)
    values = {c: {v: i for i, v in enumerate([v for d, v in names if d == c], 1)} for c, v in names if v is not None}
    plan = trees_of.Plan(
        bins=tuple(len(values[c]) + 1 if c in values else len(places[c]) + 1 for c in used), alone=tuple(c in values for c in used),
        classes=len(labels) if labels else 0, depth=depth, seed=seed, some=max(1, math.ceil(len(names) ** 0.5)) if labels else None)

    train = encoded.where("not __test")
    facts = train.agg(F.count("*").alias("n"), F.approx_count_distinct("__draw").alias("draws"), *([] if labels else [F.max(F.abs("__label")).alias("largest")])).head()
    n = facts["n"]
    top = leaves = None
    above = 0
    cell = _cell(used, places, values, plan)
    if cell is not None:
        binned = encoded.withColumn("__cell", cell)
        cells = binned.select("__cell").distinct().count()
        if cells <= subtree_rows and CELL_ROWS * cells <= n:
            draws = [r[0] for r in train.select("__draw").distinct().collect()] if facts["draws"] < FEW_DRAWS else None
            return _over_cells(binned, labels, plan, trees, depth, facts, draws, key, [named[c] if v is None else f"{named[c]}_{v}" for c, v in names])
    if n > subtree_rows:
        above = math.ceil(math.log2(n / subtree_rows)) + 2
        while True:
            above = min(above, depth)
            top = _library_forest(train, stages, inputs, labels, trees, above, seed, max_bins)
            leaves = vector_to_array(F.col("__leaves")).cast("array<int>")
            sized = top.transform(train).select(F.posexplode(leaves).alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n"))
            if above == depth or sized.agg(F.max("n")).head()[0] <= 4 * subtree_rows:
                break
            above += 3
    placed = top.transform(encoded) if top is not None else encoded
    cut = placed.select("__id", "__draw", "__test", "__label", *used, (leaves if top is not None else F.lit(None).cast("array<int>")).alias("__leaves"))
    grown = cut_lineage(_grown(cut, used, places, values, labels, plan, trees, depth - above))
    predictions = _predictions(encoded, "__id", grown, labels, trees, key)
    importances, depths = _importances(grown, encoded, labels, len(names), trees, top, above)
    return Training(problem, importances, [named[c] if v is None else f"{named[c]}_{v}" for c, v in names], predictions,
                    len(labels) if labels else None, depths, top)


def _predictions(rows: DataFrame, by: str, grown: DataFrame, labels: list[str] | None, trees: int, key: list[str]) -> DataFrame:
    """The test rows with what all trees say about their number in the column ``by``."""
    marks = grown.where("kind = 0")
    if labels is None:
        votes = marks.groupBy(F.col("id").alias(by)).agg((F.sum("value") / trees).alias("predicted"))
    else:
        shares = marks.groupBy("id", "class").agg(F.sum("value").alias("p")).groupBy(F.col("id").alias(by)).agg(F.min_by("class", F.struct(-F.round("p", 9), F.col("class"))).alias("c"))
        votes = shares.select(by, F.get(F.array(*[F.lit(x) for x in labels]), F.col("c")).alias("predicted"))
    return rows.where("__test").join(votes, by).select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(key)], F.col("__label").alias("actual"), "predicted")


def _bins(columns: dict[str, pa.Array], used: list[str], places: dict, values: dict) -> np.ndarray:
    x = np.empty((len(columns[used[0]]) if used else 0, len(used)), np.int32)
    for i, c in enumerate(used):
        if c in values:
            x[:, i] = [values[c].get(v, 0) for v in columns[c].to_pylist()]
        else:
            x[:, i] = np.searchsorted(places[c], columns[c].to_numpy(zero_copy_only=False), side="left")
    return x


def _cell(used: list[str], places: dict, values: dict, plan: trees_of.Plan) -> Column | None:
    """The number of a row's cell: its bins, written as one number; None where that does not fit 64 bits."""
    if not used or math.prod(plan.bins) * max(1, plan.classes) >= 1 << 62:
        return None

    @F.arrow_udf("bigint")
    def number(*columns: pa.Array) -> pa.Array:
        x = _bins(dict(zip(used, columns)), used, places, values)
        out = np.zeros(len(x), np.int64)
        for i, width in enumerate(plan.bins):
            out = out * width + x[:, i]
        return pa.array(out)

    return number(*[F.col(c) for c in used])


def _over_cells(rows: DataFrame, labels: list[str] | None, plan: trees_of.Plan, trees: int, depth: int, facts: Row, draws: list[int] | None,
                key: list[str], feature_names: list[str]) -> Training:
    """A forest over sums of rows in equal cells; what rows of a cell are told is the same, so predictions are looked up by cell."""
    n, largest = facts["n"], None if labels else facts["largest"]
    classes = max(1, plan.classes)
    parts = 1 if labels else 1 + len(trees_of.exact_parts(np.zeros(1), 1.0, n))  # weight, and the parts of the weighted target
    number = {x: i for i, x in enumerate(labels or [])}
    every = set() if draws is None else {t for t in range(trees) if not trees_of.times_drawn(np.array(draws, np.int64), t, plan.seed).any()}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            table = pa.Table.from_batches(held)
            cell, draw, test = (table.column(c).to_numpy() for c in ("__cell", "__draw", "__test"))
            train, said = ~test.astype(bool), table.column("__label")
            if labels:  # rows of a cell and class are one
                cell = cell * classes + np.array([number[x] for x in said.to_pylist()], np.int64)
                targets = []
            else:
                targets = trees_of.exact_parts(said.to_numpy()[train].astype(float), largest, n)
            seen, at = np.unique(cell, return_inverse=True)
            at, draw = at[train], draw[train]
            sums = np.zeros((len(seen), trees, parts))
            for tree in range(trees):
                w = np.ones(len(draw)) if tree in every else trees_of.times_drawn(draw, tree, plan.seed)
                for i, t in enumerate([None, *targets]):
                    sums[:, tree, i] = np.bincount(at, w if t is None else w * t, len(seen))
            return seen, sums

        def out(seen: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for tree in range(trees):
                own = [pa.array([x.tobytes()], pa.binary()) for x in (seen, np.ascontiguousarray(sums[:, tree]))]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *own], names=["tree", "cells", "sums"])

        held, size, total = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                total = trees_of.add_to(total, *told(held))
                held, size = [], 0
                if total[1].size > HELD:
                    yield from out(*total)
                    total = None
        if size:
            total = trees_of.add_to(total, *told(held))
        if total is not None:
            yield from out(*total)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["tree"] != now and held:
                    yield from _cell_tree(now, *_together(held), plan, depth)
                    held, size = [], 0
                now = row["tree"]
                held.append((np.frombuffer(row["cells"], np.int64), np.frombuffer(row["sums"], float).reshape(-1, parts)))
                size += len(held[-1][0])
                if size > 4 * SUBTREE_ROWS + 2 * len(held[0][0]):
                    held = [_together(held)]
                    size = len(held[0][0])
        if held:
            yield from _cell_tree(now, *_together(held), plan, depth)

    sums = rows.select("__cell", "__draw", "__test", "__label").mapInArrow(add_up, "tree int, cells binary, sums binary")
    spread = max(trees, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grown = cut_lineage(sums.repartition(spread, "tree").sortWithinPartitions("tree").mapInArrow(fill, GROWN))
    importances, depths = _importances(grown, rows, labels, len(feature_names), trees, None, 0)
    return Training("classification" if labels else "regression", importances, feature_names, _predictions(rows, "__cell", grown, labels, trees, key),
                    len(labels) if labels else None, depths)


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return held[0] if len(held) == 1 else trees_of.merged(*(np.concatenate(x) for x in zip(*held)))


def _cell_tree(tree: int, cells: np.ndarray, sums: np.ndarray, plan: trees_of.Plan, depth: int) -> Iterator[pa.RecordBatch]:
    """One tree over the sums of cells, see ``GROWN``; a row of kind 0 is of a cell."""
    places, y = (cells // plan.classes, cells % plan.classes) if plan.classes else (cells, np.zeros(len(cells)))
    x, rest = np.empty((len(cells), len(plan.bins)), np.int32), places
    for i in range(len(plan.bins) - 1, -1, -1):
        rest, x[:, i] = np.divmod(rest, plan.bins[i])
    w = sums[:, 0]
    wy = None if plan.classes else sums[:, 1:].sum(axis=1)
    ends, gains, levels = trees_of.grow(x, y, w, plan, [plan.seed, tree, 0], depth, wy)
    # entries of a cell share its leaf
    cell, first = np.unique(places, return_index=True)
    value = trees_of.values_of(ends, y, w, plan.classes, wy)[ends[first]]
    yield from _marks(tree, cell, value, plan)
    yield from _facts(tree, gains, levels)


def _split_places(rows: DataFrame, names: list[str], max_bins: int) -> dict[str, list[float]]:
    """Where each numeric feature may be split: between any two of few values, else at quantiles from a sketch."""
    if not names:
        return {}
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    sketches = rows.agg(*[x for i, c in enumerate(names) for x in (
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, F.lit(4096)), shares).alias(f"q{i}"), F.approx_count_distinct(c).alias(f"d{i}"))]).head()
    out = {}
    for i, c in enumerate(names):
        values = None
        if sketches[f"d{i}"] <= 2 * max_bins:
            values = [r[0] for r in rows.select(c).distinct().orderBy(c).limit(max_bins + 1).collect()]
        few = values is not None and len(values) <= max_bins
        edges = sorted({(a + b) / 2 for a, b in zip(values, values[1:])} if few else set(sketches[f"q{i}"] or []))
        out[c] = [e for e in edges if not math.isnan(e)]
    return out


def _library_forest(train: DataFrame, stages: list, inputs: list[str], labels: list[str] | None, trees: int, depth: int, seed: int, max_bins: int) -> PipelineModel:
    """The upper levels of all trees, each level grown over all rows at once."""
    prepare = PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol="features")])
    shared = {"featuresCol": "features", "numTrees": trees, "maxDepth": depth, "seed": seed, "maxBins": max_bins,
              "leafCol": "__leaves", "cacheNodeIds": True, "maxMemoryInMB": 1024}
    if labels is None:
        learner = RandomForestRegressor(labelCol="__label", featureSubsetStrategy="all", **shared)
        return PipelineModel([prepare, learner.fit(prepare.transform(train))])
    index = StringIndexerModel.from_labels(labels, inputCol="__label", outputCol="__class")
    learner = RandomForestClassifier(labelCol="__class", featureSubsetStrategy="sqrt", **shared)
    return PipelineModel([prepare, learner.fit(prepare.transform(index.transform(train)))])


GROWN = "kind int, tree int, id bigint, class int, value double"


def _grown(rows: DataFrame, used: list[str], places: dict, values: dict, labels: list[str] | None, plan: trees_of.Plan, trees: int, depth: int) -> DataFrame:
    """What the tasks that grow trees hand back, see ``GROWN``: predictions of test rows (kind 0; one row a class with a share), gains by column
    (1), impurity times weight before growing (2), levels grown (3)."""
    number = {x: i for i, x in enumerate(labels or [])}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows for every tree and leaf: arrays as bytes."""
        for batch in batches:
            ids, draw = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__id", "__draw"))
            test = batch.column("__test").to_numpy(zero_copy_only=False).astype(bool)
            said = batch.column("__label").to_pylist()
            y = np.array([number[x] for x in said] if labels else said, float)
            x = _bins({c: batch.column(c) for c in used}, used, places, values).reshape(len(y), len(used))
            at = None
            if batch.num_rows and batch.column("__leaves").null_count == 0:
                at = np.array(batch.column("__leaves").flatten(), np.int64).reshape(len(y), -1)
            for tree in range(trees):
                leaf = at[:, tree] if at is not None else np.zeros(len(y), np.int64)
                for one in np.unique(leaf):
                    own = leaf == one
                    parts = [ids[own], draw[own], test[own], y[own], x[own]]
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([one], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                                                     names=["tree", "leaf", "ids", "draw", "test", "y", "x"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["leaf"]) != now and held:
                    yield from _one(now, held, plan, depth)
                    held = []
                now = row["tree"], row["leaf"]
                held.append(row)
        if held:
            yield from _one(now, held, plan, depth)

    blocks = rows.mapInArrow(deal, "tree int, leaf bigint, ids binary, draw binary, test binary, y binary, x binary")
    spread = max(trees, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(spread, "tree", "leaf").sortWithinPartitions("tree", "leaf").mapInArrow(fill, GROWN)


def _one(group: tuple[int, int], held: list[dict], plan: trees_of.Plan, depth: int) -> Iterator[pa.RecordBatch]:
    tree, leaf = group
    ids, draw, test, y = (np.concatenate([np.frombuffer(r[c], kind) for r in held]) for c, kind in (("ids", np.int64), ("draw", np.int64), ("test", bool), ("y", float)))
    x = np.concatenate([np.frombuffer(r["x"], np.int32).reshape(-1, len(plan.bins)) for r in held])
    w = np.where(test, 0.0, trees_of.times_drawn(draw, tree, plan.seed))
    if not w.any():
        w = (~test).astype(float)
    used = np.flatnonzero(test | (w > 0))
    used = used[np.lexsort((y[used], draw[used]))]  # sums in the same order under any partitioning
    ids, test, y, x, w = ids[used], test[used], y[used], x[used], w[used]
    ends, gains, levels = trees_of.grow(x, y, w, plan, [plan.seed, tree, leaf], depth)
    value = trees_of.values_of(ends, y, w, plan.classes)[ends[test]]
    before = trees_of.values_of(np.zeros_like(ends), y, w, plan.classes)[0]
    spread = w.sum() * (1 - (before**2).sum()) if plan.classes else (w * (y - before[0]) ** 2).sum()

    yield from _marks(tree, ids[test], value, plan)
    yield from _facts(tree, gains, levels)
    yield _said(tree, 2, np.zeros(1), np.zeros(1), np.array([spread]))


def _said(tree: int, kind: int, i: np.ndarray, classes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), kind, np.int32)), pa.array(np.full(len(v), tree, np.int32)), pa.array(i.astype(np.int64)),
                                       pa.array(classes.astype(np.int32)), pa.array(v.astype(float))], names=["kind", "tree", "id", "class", "value"])


def _marks(tree: int, ids: np.ndarray, value: np.ndarray, plan: trees_of.Plan) -> Iterator[pa.RecordBatch]:
    row, cls = np.nonzero(value) if plan.classes else (np.arange(len(value)), np.zeros(len(value), int))
    for at in range(0, len(row), 50_000):
        part = slice(at, at + 50_000)
        yield _said(tree, 0, ids[row[part]], cls[part], value[row[part], cls[part]])


def _facts(tree: int, gains: np.ndarray, levels: int) -> Iterator[pa.RecordBatch]:
    column = np.flatnonzero(gains)
    yield _said(tree, 1, np.zeros(len(column)), column, gains[column])
    yield _said(tree, 3, np.zeros(1), np.zeros(1), np.array([levels]))


def _importances(grown: DataFrame, rows: DataFrame, labels: list[str] | None, columns: int, trees: int, top: PipelineModel | None, above: int) -> tuple[list[float], list[int]]:
    """Gains by column, of each tree as shares, then the mean over trees; and the levels of each tree."""
    found = grown.where("kind > 0").groupBy("kind", "tree", "class").agg(F.sum("value").alias("s"), F.max("value").alias("m")).collect()
    gains = np.zeros((trees, columns))
    left, depths = np.zeros(trees), [above] * trees
    for r in found:
        if r["kind"] == 1:
            gains[r["tree"], r["class"]] += r["s"]
        elif r["kind"] == 2:
            left[r["tree"]] = r["s"]
        else:
            depths[r["tree"]] += int(r["m"])
    if top is not None:  # what the upper levels gained, shared out as the library says
        train = rows.where("not __test")
        if labels is None:
            root = train.agg(F.var_pop("__label") * F.count("*")).head()[0]
        else:
            root = train.groupBy("__label").agg(F.count("*").alias("n")).agg(F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).head()[0]
        for t, tree in enumerate(top.stages[-1].trees):
            gains[t] += max(0.0, root - left[t]) * np.asarray(tree.featureImportances.toArray())
    shares = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    total = shares.sum()
    return (shares.sum(axis=0) / (total or 1.0)).tolist(), depths


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """R2, mean absolute and root mean squared error of (actual, predicted)."""
    error = F.col("actual") - F.col("predicted")
    return predictions.agg(
        F.sum(error * error).alias("sse"), F.var_pop("actual").alias("var"), F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
    ).select(
        (1 - F.try_divide(F.col("sse"), F.col("var") * F.col("n"))).alias("r2"), "mae",
        F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"))


def classification_metrics(predictions: DataFrame, all_rows: DataFrame, target: str) -> DataFrame:
    """Accuracy on the test rows, number of classes over all rows, number of test rows."""
    classes = (all_rows.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n"))
               .agg(F.count("*").alias("classes")).scalar())
    return predictions.agg(
        F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"),
        F.count("*").alias("test_rows"),
    ).select("accuracy", classes.alias("classes"), "test_rows")


def feature_importance(training: Training, top: int = TOP_FEATURES) -> DataFrame:
    """The most important features, in falling order."""
    rows = list(zip(training.feature_names, training.importances))
    frame = training.predictions.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def actual_vs_predicted(training: Training) -> DataFrame:
    """The test pairs with the ends of the diagonal they are compared to."""
    actual = training.predictions.agg(F.struct(F.min("actual").alias("lo"), F.max("actual").alias("hi")).alias("s")).scalar()
    return training.predictions.select("*", actual["lo"].alias("line_low"), actual["hi"].alias("line_high"))

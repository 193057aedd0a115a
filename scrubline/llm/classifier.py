"""Quality classifier: a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Features are the words, pairs of words and byte triples of a text, hashed into BUCKETS indicators, and n-grams of one repeated
word, with an indicator for each n of RUNS. Over all labelled rows,
each bucket's documents are counted by class; the log ratio r of the smoothed class frequencies scales the indicators. On
a sample of at most SAMPLE rows a class, a linear hinge-loss model is fitted by dual coordinate descent, on
rows scaled to unit length, and a slope and an offset turn its margins into probabilities. The sample is the bound
of what is fitted on; counts cover every labelled row, and scores every row.

Memory: a worker holds one mark per bucket; the driver gets the summed counts (two numbers a bucket) and the sample, at most 32 KB a row.

Defined results: a null text is an empty one and is scored by the offset alone; labels other than 0 and 1, and
labels or rows without an id, teach nothing; repeated rows and labels count as often as they occur; without labels of both classes every
score is the smoothed share of label 1 (0.5 without any); other columns stay, one named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction, materialize, slices
from .shingles import PLACE, blocks, mix, word_hashes

BITS = 18
BUCKETS = 1 << BITS
CHUNK = 1 << 12  # buckets whose counts travel in one row
SAMPLE = 2_000
C = 1.0
EPOCHS = 30
RUNS = np.array([3, 4, 6, 8, 12, 16, 24, 32])  # equal words in a row, with the first buckets as indicators
HELD_BACK = 4  # every fourth row of the sample calibrates instead of fitting


def longest_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, how often the same word stands in a row at most; texts are cut at ``first``."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        new = np.ones(len(words), bool)
        new[1:] = words[1:] != words[:-1]
        new[first[full]] = True
        starts = np.flatnonzero(new)
        out[full] = np.maximum.reduceat(np.diff(np.append(starts, len(words))), np.searchsorted(starts, first[full]))
    return out


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of buckets of each text, ascending."""
    mark = np.zeros(BUCKETS, np.uint8)
    shift = np.uint64(64 - BITS)
    for i, j in blocks(texts):
        words, first = word_hashes(texts[i:j])
        singles = (words >> shift).astype(np.int64)
        runs = longest_runs(words, first)
        pairs = (mix(words[:-1] * PLACE[0] + words[1:] * PLACE[1]) >> shift).astype(np.int64)
        for k, text in enumerate(texts[i:j]):
            a, b = first[k], first[k + 1]
            own = [singles[a:b], pairs[a : max(b - 1, a)], np.flatnonzero(runs[k] >= RUNS)]
            if len(text) > 2:
                raw = np.frombuffer(text, np.uint8).astype(np.uint32)
                own.append(((((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
            for x in own:
                mark[x] = 1
            yield np.flatnonzero(mark)
            for x in own:
                mark[x] = 0


def _pack(own: np.ndarray) -> bytes:
    """A set of buckets as numbers or, where that is shorter, as bits."""
    if len(own) * 4 < BUCKETS // 8:
        return own.astype("<u4").tobytes()
    bits = np.zeros(BUCKETS, np.uint8)
    bits[own] = 1
    return np.packbits(bits).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) < BUCKETS // 8:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # of the scaled indicators
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.product, self.square = self.ratio * self.weight, np.square(self.ratio)

    def margins(self, sets) -> Iterator[float]:
        product, square = self.product, self.square
        for own in sets:
            norm = np.sqrt(square[own].sum())
            yield (product[own].sum() / norm if norm else 0.0) + self.bias

    def scores(self, sets) -> list[float]:
        z = np.fromiter(self.margins(sets), float) * self.slope + self.offset
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: weights and bias (the weight of a constant 1).

    Each step solves the dual for one row's multiplier, kept between 0 and its cost, and moves the weights along the row.
    """
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    square = np.array([v @ v + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            own, v = rows[i]
            slope = y[i] * (w[own] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[own] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps on smoothed targets."""
    hi, lo = (weight[y == 1].sum() + 1) / (weight[y == 1].sum() + 2), 1 / (weight[y == 0].sum() + 2)
    target, a, b = np.where(y == 1, hi, lo), 1.0, 0.0

    def loss(a, b):
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-12)
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-8 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", teaches: Column | None = None,
          sample: int = SAMPLE) -> Model:
    """Fit on the rows of df that have a label. ``teaches``: a condition on the key, on both frames."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isin(0, 1))
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if teaches is not None:
        known, rows = known.where(teaches), rows.where(teaches)
    known = known.withColumnRenamed(key, "k")
    sizes = dict(known.groupBy("y").count().collect())
    chance = F.when(F.col("y") == 1, sample / max(sizes.get(1, 0), 1)).otherwise(sample / max(sizes.get(0, 0), 1))
    # labels grow with the rows, so both sides are always sorted and merged
    joined = rows.join(known.hint("merge"), F.col(key) == F.col("k")).select("text", "y", (fraction(F.lit("sample"), F.col("k")) < chance).alias("chosen"), F.col("k").cast("string").alias("k"))
    schema = pa.schema([("chunk", pa.int32()), ("y", pa.int32()), ("k", pa.string()), ("data", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        sizes = np.zeros(2, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            chosen = []
            texts = [x.encode() for x in batch["text"].to_pylist()]
            for own, y, k, take in zip(features(texts), batch["y"].to_pylist(), batch["k"].to_pylist(), batch["chosen"].to_pylist()):
                totals[y][own] += 1
                sizes[y] += 1
                if take:
                    chosen.append({"chunk": -1, "y": y, "k": k, "data": _pack(own)})
            yield pa.RecordBatch.from_pylist(chosen, schema)
        if sizes.any():
            yield pa.RecordBatch.from_pylist([{"chunk": -2, "y": None, "k": None, "data": sizes.tobytes()}] + [
                {"chunk": c, "y": None, "k": None, "data": totals[:, c * CHUNK:(c + 1) * CHUNK].tobytes()} for c in range(BUCKETS // CHUNK)], schema)

    seen = materialize(joined.mapInArrow(count, "chunk int, y int, k string, data binary"), "counted")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch["chunk"].to_pylist(), batch["data"].to_pylist()):
                own = np.frombuffer(data, np.int64)
                sums[c] = sums[c] + own if c in sums else own.copy()
        yield pa.RecordBatch.from_pylist([{"chunk": c, "data": x.tobytes()} for c, x in sums.items()], pa.schema([("chunk", pa.int32()), ("data", pa.binary())]))

    counts = seen.where("chunk <> -1").select("chunk", "data").repartition("chunk").mapInArrow(add, "chunk int, data binary").collect()
    by_chunk = {c: np.frombuffer(data, np.int64) for c, data in counts}
    n = by_chunk.get(-2, np.zeros(2, np.int64))
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    totals = np.concatenate([by_chunk[c].reshape(2, CHUNK) for c in range(BUCKETS // CHUNK)], axis=1)
    frequency = (totals + 1) / (n + 2)[:, None]
    ratio = np.log(frequency[1] / frequency[0])
    # a key may stand for many rows: of those drawn, no more than the sample of each class, by a hash
    own = seen.where("chunk = -1").select("y", "k", "data", F.xxhash64("k", "data").alias("h"))
    drawn = [(r["y"], r["k"], bytes(r["data"])) for c in (0, 1) for r in own.where(F.col("y") == c).orderBy("h", "k", "data").limit(sample).collect()]
    return fit(ratio, sorted(drawn, key=lambda r: (r[1], r[2], r[0])), n)


def fit(ratio: np.ndarray, drawn: list[tuple[int, str, bytes]], n: np.ndarray) -> Model:
    """The model of the drawn rows (label, key, packed buckets); n: how many rows each class has in all."""
    y = np.array([r[0] for r in drawn])
    rows = []
    for r in drawn:
        own = _unpack(r[2])
        v = ratio[own]
        norm = np.sqrt(v @ v)
        rows.append((own, v / norm if norm else v))
    held = np.arange(len(drawn)) % HELD_BACK == 0
    if len(drawn) < 40 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(drawn), bool)  # too few to hold any back
        taught = held
    else:
        taught = ~held
    chosen = np.flatnonzero(taught)
    of_class = np.bincount(y[chosen], minlength=2)
    cost = C * len(chosen) / (2 * np.maximum(of_class, 1))[y[chosen]]
    w, bias = descend([rows[i] for i in chosen], 2 * y[chosen] - 1, cost, len(ratio))
    margin = np.array([w[own] @ v + bias for own, v in rows])
    weight = (n / np.maximum(np.bincount(y, minlength=2), 1))[y]  # the sample's classes count as in all rows
    slope, offset = calibrate(margin[held], y[held], weight[held])
    return Model(ratio, w, bias, slope, offset)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1. The model (a few MB, fixed by BUCKETS) is broadcast."""
    sent = df.sparkSession.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model)})  # plain arrays and numbers

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model, out = Model(**sent.value), []
        for part in slices(texts):
            out += model.scores(features([(x or "").encode() for x in part.to_pylist()]))
        return pa.array(out, pa.float64())

    return df.withColumn(out, run(F.col(text)))

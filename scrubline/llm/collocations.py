"""Phrases whose words stand together more often than their parts suggest, from a weighted de Bruijn graph.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. A node of the graph is ``max_words - 1``
words, an edge the ``max_words`` words by which two nodes overlap, weighted with its occurrences. Edges are aggregated once;
all shorter counts follow from them: a piece's last words are edges filled up with END, so a phrase occurs as often as
edges that begin with it weigh, which is the flow out of its node plus the pieces that end there. Edges sorted by their words are summed
for all lengths in one pass that keeps one open run a length. The frequent part of the graph is compacted: a chain of nodes with one
edge in and one out becomes one path, and what a phrase is part of is read from the paths.

Words are 64-bit hashes of language and word on the way. A dictionary of all words proves that no two share one; if any did, the next seed
would be taken, so results are exact. Everything is per language.

Defined results: a null text is empty, a null language ``und``; rows are counted as often as they stand there; ties go by the order the
result names; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices

END = 0  # stands behind the last word of a piece
CHUNK = 1 << 21  # words that are counted together before anything is shuffled
BLOCK = 1 << 16  # rows of an output batch
PARTS = 64  # in which a language's phrases are ranked before all of them are
SEGMENT = 1024  # edges of a path in one row

# Characters that end a piece, and those between words.
PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
PLAIN = bytes(ord(" ") if c in GAPS else ord("\n") if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Ids(dict):
    """Numbers of a language's words in a chunk, and the hash of each in the list all languages share."""

    def __init__(self, lang: str, seed: int, hashes: list[int]):
        super().__init__({b"\n": END})
        self.lang, self.seed, self.hashes = lang, seed, hashes
        self.prefix = f"{len(lang)}:{lang}:".encode()

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(self.prefix + word, self.seed))
        number = self[word] = len(self.hashes) - 1
        return number


def chunks(batches: Iterator[pa.RecordBatch], seed: int, most: int) -> Iterator[tuple[np.ndarray, list[int], dict[str, Ids]]]:
    """Of about ``most`` words each: numbers of the words in order with END between pieces; hashes by number; words by language."""
    parts, words, hashes, known = [], 0, [END], {}
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = known.get(lang)
                if own is None:
                    own = known[lang] = Ids(lang, seed, hashes)
                tokens = [w for w in text.encode().translate(PLAIN).replace(b"\n", b" \n ").split(b" ") if w]
                parts.append(np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens)))
                parts.append(np.zeros(1, np.int32))
                words += len(tokens)
                if words >= most:
                    yield np.concatenate(parts), hashes, known
                    parts, words, hashes, known = [], 0, [END], {}
    if words:
        yield np.concatenate(parts), hashes, known


def count_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns with values below ``size``, and how often each occurs."""
    code, top = columns[0].astype(np.int64), size
    back: list[np.ndarray] = []
    for column in columns[1:]:
        if top * size >= 1 << 62:  # too wide for one number: rows so far are numbered anew
            seen, code = np.unique(code, return_inverse=True)
            back.append(seen)
            top = len(seen) + 1
        else:
            back.append(np.empty(0, np.int64))
        code, top = code * size + column, top * size
    code, n = np.unique(code, return_counts=True)
    out = []
    for seen in reversed(back):
        out.append(code % size)
        code = code // size
        if len(seen):
            code = seen[code]
    return [code, *reversed(out)], n


def grams(numbers: np.ndarray, length: int) -> list[np.ndarray]:
    """For every word the ``length`` words from it on, END from the end of its piece on."""
    padded = np.concatenate([numbers, np.zeros(length, numbers.dtype)])
    first = np.flatnonzero(numbers)
    columns = [numbers[first]]
    for k in range(1, length):
        columns.append(np.where(columns[-1] == END, END, padded[first + k]))
    return columns


def prepared(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def dictionary(texts: DataFrame, most: int = CHUNK) -> tuple[DataFrame, int]:
    """All words (id, lang, word), written; and the seed under which their ids differ."""
    seed = 0
    while True:
        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for _, hashes, known in chunks(batches, seed, most):
                ids = np.array(hashes, np.uint64).view(np.int64)
                for lang, own in known.items():
                    words = pa.array([*own][1:], pa.binary())
                    if len(words):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[[*own.values()][1:]]), pa.array([lang] * len(words), pa.string()), words.cast(pa.string())],
                                                         names=["id", "lang", "word"])
        words = materialize(texts.mapInArrow(run, "id bigint, lang string, word string").distinct(), "words")
        shared = words.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("id") == END))
        if not shared.head(1):
            return words, seed
        seed += 1


def counted(texts: DataFrame, seed: int, length: int, least: int, most: int = CHUNK) -> DataFrame:
    """Written counts (size, w0, w1, ..., n): of each phrase of 2 to ``length`` words that occurs ``least`` times, and of single words.

    Single words come as several partial counts, to be added up.
    """
    names = [f"w{k}" for k in range(length)]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, hashes, _ in chunks(batches, seed, most):
            ids = np.array(hashes, np.uint64).view(np.int64)
            columns, n = count_rows(grams(numbers, length), len(hashes))
            for at in range(0, len(n), BLOCK):
                yield pa.RecordBatch.from_arrays([*(pa.array(ids[c[at : at + BLOCK]]) for c in columns), pa.array(n[at : at + BLOCK])], names=[*names, "n"])

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[tuple, int]] = {}
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                yield from _runs(columns[:-1], columns[-1], open_, least)
        for size, (words, n) in open_.items():
            yield _rows(size, length, [np.array([w], np.int64) for w in words], np.array([n], np.int64), least)

    dealt = texts.mapInArrow(edges, ", ".join(f"{c} bigint" for c in [*names, "n"])).repartition("w0", "w1").sortWithinPartitions(*names)
    return materialize(dealt.mapInArrow(flows, ", ".join(["size int", *(f"{c} bigint" for c in [*names, "n"])])), "counts")


def _runs(columns: list[np.ndarray], n: np.ndarray, open_: dict, least: int) -> Iterator[pa.RecordBatch]:
    """Sums over equal first words of sorted rows, for every number of words; the last run of each stays open."""
    length = len(columns)
    new = np.zeros(len(n), bool)
    new[0] = True
    for size in range(1, length + 1):
        new[1:] |= columns[size - 1][1:] != columns[size - 1][:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n, starts)
        words = [c[starts] for c in columns[:size]]
        before = open_.get(size)
        if before:
            if before[0] == tuple(int(c[0]) for c in words):
                sums[0] += before[1]
            else:
                words, sums = [np.append(w, c) for w, c in zip(before[0], words)], np.append(before[1], sums)
        open_[size] = tuple(int(c[-1]) for c in words), int(sums[-1])
        yield _rows(size, length, [c[:-1] for c in words], sums[:-1], least)


def _rows(size: int, length: int, words: list[np.ndarray], n: np.ndarray, least: int) -> pa.RecordBatch:
    if size > 1:
        keep = (n >= least) & (words[-1] != END)
        words, n = [c[keep] for c in words], n[keep]
    nulls = pa.nulls(len(n), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), *(pa.array(c.astype(np.int64)) for c in words), *[nulls] * (length - size), pa.array(n.astype(np.int64))],
                                      names=["size", *(f"w{k}" for k in range(length)), "n"])


def compact(edges: DataFrame) -> DataFrame:
    """Paths of a graph given by its edges (words, n): words and the weights of a path's edges, in rows of at most SEGMENT edges.

    A node with one edge in and one out lies inside a path. Each edge finds the first edge of its path by doubling: in every round it looks as
    far back as twice the way so far. A closed ring of such nodes has no first edge; its edges are paths of their own.
    """
    size = F.size("words")
    edges = edges.select("words", "n", F.slice("words", 1, size - 1).alias("source"), F.slice("words", F.lit(2), size - 1).alias("target"))
    ins = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n_in"), F.min("words").alias("before"))
    outs = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n_out"))
    inside = ins.join(outs, "node").where("n_in = 1 and n_out = 1").select(F.col("node").alias("source"), "before")
    state = materialize(edges.join(inside, "source", "left").select(
        "words", "n", F.coalesce("before", "words").alias("first"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("place"),
        F.col("before").isNull().alias("done")), "paths")
    waiting = None
    while True:
        left = state.where("not done").count()
        if left == 0 or left == waiting:
            break
        waiting = left
        ahead = state.select(F.col("words").alias("first"), F.col("first").alias("_first"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        further = state.where("not done").join(ahead, "first").select("words", "n", F.col("_first").alias("first"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done"))
        state = materialize(state.where("done").unionByName(further), "paths")
    own = F.col("done")
    named = state.select("words", "n", F.when(own, F.col("first")).otherwise(F.col("words")).alias("first"), F.when(own, F.col("place")).otherwise(0).alias("place"))
    rows = named.groupBy("first", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("place", "words", "n"))).alias("edges"))
    return rows.select(
        "first", "segment",
        F.concat(F.col("edges")[0]["words"], F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.element_at(e["words"], -1))).alias("words"),
        F.col("edges.n").alias("weights"))


def heaviest_beside(paths: DataFrame, node_words: int) -> DataFrame:
    """For every node of the compacted graph (words) the heaviest edge in or out of it (n)."""
    at = F.sequence(F.lit(0), F.size("weights"))
    nodes = paths.select(F.explode(F.transform(at, lambda i: F.struct(
        F.slice("words", i + 1, F.lit(node_words)).alias("words"),
        F.greatest(F.get("weights", i - 1), F.get("weights", i)).alias("n")))).alias("x")).select("x.*")
    return nodes.groupBy("words").agg(F.max("n").alias("n"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10, inside: int = 50, limit: int | None = 2000,
                 chunk: int = CHUNK) -> DataFrame:
    """The phrases of 2 to ``max_words`` words that occur ``least`` times, best first in each language.

    A phrase of ``a`` occurrences cut into two parts of ``l`` and ``r`` occurrences scores floor(1000000 a a / (l r)); its worst cut counts. Phrases
    inside a longer one that occurs at least ``inside`` percent as often are dropped. ``limit``: rows for each language. ``n``: the language's words.
    """
    texts = prepared(df, text, lang)
    words, seed = dictionary(texts, chunk)
    counts = counted(texts, seed, max_words, least, chunk)
    names = [f"w{k}" for k in range(max_words)]
    single = counts.where("size = 1").groupBy(F.col("w0").alias("id")).agg(F.sum("n").alias("n")).join(words.hint("merge"), "id")
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    known = materialize(single.where(F.col("n") >= least), "frequent")
    phrases = counts.where("size > 1").select(F.filter(F.array(*names), lambda w: w.isNotNull()).alias("words"), "n")
    flow = phrases.unionByName(known.select(F.array("id").alias("words"), "n"))

    paths = compact(phrases.where(F.size("words") == max_words))
    longer = [heaviest_beside(paths, max_words - 1)] if max_words > 2 else []
    for size in range(3, max_words):  # shorter ones: by the phrases one word longer
        for start in (1, 2):
            longer.append(phrases.where(F.size("words") == size).select(F.slice("words", start, size - 1).alias("words"), "n"))
    kept = phrases
    if longer:
        held = reduce(DataFrame.unionByName, longer).groupBy("words").agg(F.max("n").alias("in_longer"))
        kept = phrases.join(held.hint("merge"), "words", "left").where(F.col("in_longer").isNull() | (100 * F.col("in_longer") < inside * F.col("n"))).select("words", "n")

    size = F.size("words")
    cuts = kept.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(flow.select(F.col("words").alias("left"), F.col("n").alias("l")).hint("merge"), "left").join(flow.select(F.col("words").alias("right"), F.col("n").alias("r")).hint("merge"), "right")
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", exact).groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst")).select(
        "words", "a", "worst.l", "worst.r", "worst.score", F.col("words")[0].alias("id"))
    scored = scored.join(known.select("id", "lang").hint("merge"), "id")
    if limit is not None:  # ties stay until their words are known
        best_first = [F.desc("score"), F.desc("a")]
        scored = scored.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(PARTS)))
        for group in (["lang", "part"], ["lang"]):  # a language's best are among the best of its parts
            scored = scored.withColumn("rank", F.rank().over(W.partitionBy(*group).orderBy(*best_first))).where(F.col("rank") <= limit)
        scored = scored.drop("rank", "part")
    spelled = scored.select("lang", "words", "a", "l", "r", "score", F.posexplode("words").alias("at", "id")).join(known.select("id", "word").hint("merge"), "id")
    spelled = spelled.groupBy("lang", "words", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint"))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

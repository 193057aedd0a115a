"""Words that differ by a single edit, grouped under the most frequent form, by dense comparison of tiles of words.

Two words are near if one inserted, deleted or replaced code point turns one into the other: their common prefix and common suffix
together reach the longer length minus one. To compare few words, the places of a word of length M are cut into CUTS ranges. The
edit of a near pair lies in one of them, so both words agree before and behind it; a bucket holds the words that do. A word enters
the buckets of its own length, and of the next one as the shorter word. Buckets are cut into chunks of a bounded number of words, and
a tile compares one chunk with another or itself: small tiles are packed into one matrix of padded code points, aligned left for
prefixes and right for suffixes. The common prefix says in which range the edit lies, so a pair counts in one tile only. Tiles give
back one row a word (count and best partner), never pairs.

Defined results: a null text has no words; a null document id is hashed as an empty text; repeated rows count as often as they stand there; ties
go to the word that is smaller in code points; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

CUTS = 3
CHUNK = 256  # words on one side of a tile, on average
MATRIX = 256  # rows of one dense comparison, if its tiles are small
FLUSH = 1 << 18  # different words counted together before they are shuffled

# Bytes of Latin-1 text that are letters of a word, with A-Z lower-cased; all others separate words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spoilt_words(text: str, key: str, every: int) -> Counter:
    """How often a text holds each word, after some words have lost a code point: which and where, says a CRC-32 of key and word."""
    out: Counter = Counter()
    start = zlib.crc32(f"{key}:".encode())
    # characters beyond Latin-1 become question marks, which separate words
    for word, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if every and h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(df: DataFrame, text: str = "text", key: str = "doc_id", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """Words (word, n) of at least ``shortest`` code points that occur at least ``least`` times. ``every=0`` leaves all words whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in spoilt_words(x, k, every).items():
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= FLUSH:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    texts = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def buckets(words: DataFrame, cuts: int = CUTS) -> DataFrame:
    """Each word once for every bucket it is in: (longer, cut, low, high, shared) and the word's own columns.

    ``longer``: the longer length of the pairs compared there; the edit lies at a place from ``low`` on and before ``high``.
    """
    length = F.char_length("word")
    classes = words.withColumn("longer", F.explode(F.array(length, length + 1))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    classes = classes.withColumn("low", F.floor(F.col("cut") * F.col("longer") / cuts).cast("int")).withColumn("high", F.floor((F.col("cut") + 1) * F.col("longer") / cuts).cast("int"))
    # the shared part behind the edit is as long for both words
    shared = F.concat(F.substring(F.col("word"), F.lit(1), F.col("low")), F.when(F.col("high") < F.col("longer"), F.expr("right(word, longer - high)")).otherwise(""))
    return classes.where("low < high").withColumn("shared", shared)


def tiles(bucketed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Words of buckets with at least two of them, once for every tile (i, j) of their bucket's chunks that needs them.

    ``side``: whether the word is of the first, the second or (2) the one chunk of its tile.
    """
    bucket = ["longer", "cut", "shared"]
    sizes = bucketed.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    held = bucketed.join(sizes.hint("merge"), bucket).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    partners = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = held.withColumn("other", F.explode(partners))
    return met.select(*bucket, "low", "high", "word", "n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of padded code points, and their lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.array(words, f"<U{max(1, n.max(initial=1))}").view(np.uint32).reshape(len(words), -1), n


def common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row of one matrix and each of the other the number of leading columns in which they agree."""
    out = np.zeros((len(left), len(right)), np.int16)
    alike = np.ones(out.shape, bool)
    for a, b in zip(left.T, right.T):
        alike &= a[:, None] == b[None, :]
        if not alike.any():
            break
        out += alike
    return out


def near_cells(words: list[str], tile: np.ndarray, side: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Cells (row, column) of the dense comparison of the given rows with all rows: pairs of a tile that are near with the edit in its range."""
    heads, n = code_points(words)
    tails, _ = code_points([w[::-1] for w in words])
    shortest = np.minimum(n[rows, None], n[None, :])
    same = (tile[rows, None] == tile[None, :]) & ((side[rows, None] + side[None, :] == 1) | (side[rows, None] == 2))
    # of two shorter words the longer one is not as long as the tile says
    same &= np.maximum(n[rows, None], n[None, :]) == longer[rows, None]
    prefix = np.minimum(common(heads[rows], heads), shortest)
    suffix = np.minimum(common(tails[rows], tails), shortest)
    near = same & (prefix + suffix >= longer[rows, None] - 1) & (prefix < longer[rows, None])
    near &= (prefix >= low[rows, None]) & (prefix < high[rows, None])
    return np.nonzero(near)


def compare_tiles(tiled: DataFrame, matrix: int = MATRIX) -> DataFrame:
    """Per word and tile: how many words of the tile are near (n_near), the largest count of those and the first of them (best_n, best)."""
    bucket = ["longer", "cut", "shared", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in [*bucket, "side", "low", "high", "word", "n"])):
                if len(held) >= matrix and held[-1][:5] != row[:5]:
                    yield _compared(held, matrix)
                    held = []
                held.append(row)
        if held:
            yield _compared(held, matrix)

    return tiled.repartition(*bucket).sortWithinPartitions(*bucket).select(*bucket, "side", "low", "high", "word", "n").mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


def _compared(held: list[tuple], matrix: int) -> pa.RecordBatch:
    words, counts = [r[8] for r in held], np.array([r[9] for r in held])
    numbers: dict[tuple, int] = {}
    tile = np.array([numbers.setdefault(r[:5], len(numbers)) for r in held])
    longer, side, low, high = (np.array([r[k] for r in held]) for k in (0, 5, 6, 7))
    out: dict[str, list] = {}
    for start in range(0, len(held), matrix):
        first, second = near_cells(words, tile, side, longer, low, high, slice(start, start + matrix))
        for a, b in zip((first + start).tolist(), second.tolist()):
            own = out.setdefault(words[a], [0, 0, ""])
            own[0] += 1
            n = int(counts[b])
            if n > own[1] or n == own[1] and words[b] < own[2]:
                own[1:] = n, words[b]
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([x[0] for x in out.values()], pa.int64()),
                                       pa.array([x[1] for x in out.values()], pa.int64()), pa.array([x[2] for x in out.values()], pa.string())],
                                      names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, cuts: int = CUTS, chunk: int = CHUNK, matrix: int = MATRIX) -> DataFrame:
    """Words (word, n) that have near ones: n_near, and the most frequent of them (near_n, near)."""
    found = compare_tiles(tiles(buckets(words, cuts), chunk), matrix)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: from ``word`` on along ``form`` to a word without one. Ways double in every round; forms must not lead in a ring."""
    state = materialize(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNull().alias("done")), "roots")
    while state.where("not done").limit(1).count():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_root"), F.col("done").alias("_done"))
        moved = state.where("not done").join(ahead.hint("merge"), "root").select("word", F.col("_root").alias("root"), F.col("_done").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "roots")
    return forms.join(state.select("word", "root").hint("merge"), "word")


def spelling_variants(words: DataFrame, ratio: int = 2, **sizes) -> DataFrame:
    """Words (word, n) with ``form``: the near word of largest n, if that is at least ``ratio`` (over 1) times the word's own; and its ``root``.

    A null word is none and left out; words must differ.
    """
    words = materialize(words.where(F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    near = words.join(near_words(words, **sizes).hint("merge"), "word", "left")
    taken = F.col("near_n") >= ratio * F.col("n")
    forms = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")), "forms")
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")

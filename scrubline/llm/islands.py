"""Packing of documents into as few sequences of fixed length as possible, by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into pieces; no other is. Pieces are dealt at random into shards of about SHARD pieces. Every shard is
packed by several islands, each with a few packings of its own. A child takes whole well-filled bins of one parent into the other, whose bins
with the same pieces are emptied; the pieces displaced go, longest first, where they fit best. After every epoch the best packing of each island
moves to the next island of its shard, where it takes the worst one's place. An island whose best packing is as good as any can be rests. The shards'
badly filled bins are then opened and their pieces dealt into fewer shards, which are packed in the same way, until one shard holds them all.

What moves between tasks are lengths and bin numbers, never texts or ids; a task holds one island at a time.

Defined results: a null text is empty, and its document is the closing id alone; null and repeated keys are packed like others; an empty table
gives no rows; other columns are ignored. Draws are fixed by the pieces and their place in the input's tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import materialize, slices, worker_state

LENGTH = 4096
SHARD = 4096  # pieces packed together, on average
ISLANDS, PACKINGS, EPOCHS, CHILDREN = 3, 4, 2, 3
WELL_FILLED = 0.98  # bins filled less are opened again for the next level
LONGEST = 64  # longer parts are encoded anew each time
REMEMBERED = 600_000  # parts of texts whose ids a worker remembers, in each of two generations

MARKS = ".,;:!?\"()[]{}<>|/*#%&$+=_~^@"  # a run of them behind a word is a word of its own

# Texts with characters beyond U+024F, whose lower case or composition may depend on their neighbours, or with controls that libraries disagree on, are left to the tokenizer itself.
UNUSUAL = "[\x1c-\x1fİɐ-\U0010ffff]"


def places_of_none(values: list) -> list[int]:
    places, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        places.append(at)
    return places


class WordEnds:
    """Ids of texts by a tokenizer file whose words end in tokens of their own; parts of texts met before are not encoded again.

    Tokens never span white space, so a text's ids are those of its parts between white space in turn.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile(UNUSUAL).search
        # lower-cased letters need no normalizing and no pattern: half the time
        self.letters = Tokenizer.from_str(spec)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.marks: dict[str, bytes] = {}
        self.border = self._border()

    def ids(self, text: str, by: Tokenizer | None = None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _border(self) -> tuple[str, int] | None:
        """A character beyond usual texts that is one token by itself, and its id: it parts what is encoded in one call."""
        for code in range(0x2600, 0x27C0):
            ids = self.ids(f" a {chr(code)} a ")
            if len(ids) == 3 and ids[1] != ids[0]:
                return f" {chr(code)} ", int(ids[1])
        return None

    def usual(self, text: str) -> bool:
        return self.border is not None and not self.unusual(text) and not any(token in text for token in self.added)

    def learn(self, new: set[str]) -> None:
        """Encode parts that are not known, those that are one word, or one and marks behind it, in a single call."""
        words, marked, other = set(), [], []
        for part in new:
            word = part.rstrip(MARKS)
            if not word.isalpha():
                other.append(part)
                continue
            words.add(word)
            if len(word) < len(part):
                marked.append((part, word))
        words = list(words.difference(self.parts))
        ids = self.ids(" ".join(words), self.letters)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            self._keep(words, ids, stops, 0)
        else:  # a word that is not one to the tokenizer
            other = list(new)
        mark, border = self.border
        if other:
            ids = self.ids(mark.join(other) + mark)
            self._keep(other, ids, np.flatnonzero(ids == border), 1)
        for part, word in marked:
            if part not in self.parts:
                end = part[len(word) :]
                if end not in self.marks:
                    self.marks[end] = self.ids(end).tobytes()
                self.parts[part] = self.parts[word] + self.marks[end]

    def _keep(self, parts: list[str], ids: np.ndarray, stops: np.ndarray, between: int) -> None:
        data, at = ids.tobytes(), 0
        for part, stop in zip(parts, (4 * stops).tolist(), strict=True):
            self.parts[part] = data[at:stop]
            at = stop + 4 * between

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.parts) >= REMEMBERED:  # parts not used since the last time are forgotten
            self.older, self.parts = self.parts, {}
        get = self.parts.get
        cut = [x.lower().split() if self.usual(x) else [] for x in texts]
        found = [list(map(get, own)) for own in cut]
        gaps = [places_of_none(known) for known in found]
        new = {own[i] for own, missing in zip(cut, gaps) for i in missing}
        again = {part for part in new if part in self.older}
        self.parts.update((part, self.older[part]) for part in again)
        new -= again
        if new:
            self.learn(new)
        out = []
        for text, own, known, missing in zip(texts, cut, found, gaps):
            for i in missing:
                known[i] = self.parts[own[i]]
            out.append(b"".join(known) if own or not text else self.ids(text).tobytes())
        for part in new:
            if len(part) > LONGEST:
                del self.parts[part]
        if len(self.marks) > REMEMBERED or any(len(part) > LONGEST for part in new):
            self.marks.clear()
        return out


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, closing: int = 1) -> DataFrame:
    """The pieces of each document's ids, ``closing`` last: (doc_id, piece, start, length, ids_crc32, draw)."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    size, last = 4 * length, closing.to_bytes(4, "little")
    kind = df.schema[key].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("word ends")
        if state.get("spec") != spec.value:
            state.update(spec=spec.value, encode=WordEnds(spec.value))
        for batch in batches:
            for part in slices(batch):
                owner, first, n, check = [], [], [], []
                for i, ids in enumerate(state["encode"](part.column(1).to_pylist())):
                    ids += last
                    for at in range(0, len(ids), size):
                        own = ids[at : at + size]
                        owner.append(i)
                        first.append(at // 4)
                        n.append(len(own) // 4)
                        check.append(zlib.crc32(own))
                start = pa.array(first, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(np.array(first, np.int64) // length).cast(pa.int32()), start,
                                                  pa.array(n, pa.int64()), pa.array(check, pa.int64())], names=names)

    cut = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return cut.withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))


class Bins:
    """Bins of a packing by free space, to find the fullest one that still has room; spaces in use are bits of one number."""

    def __init__(self, length: int):
        self.length, self.used, self.bins = length, 0, [[] for _ in range(length + 1)]

    def put(self, number: int, free: int) -> None:
        self.bins[free].append(number)
        self.used |= 1 << free

    def best(self, size: int) -> tuple[int, int] | None:
        room = self.used >> size
        if not room:
            return None
        free = size + (room & -room).bit_length() - 1
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.used ^= 1 << free
        return number, free


def best_fit(sizes: np.ndarray, order: np.ndarray, bin_of: np.ndarray, loads: list[int], length: int) -> np.ndarray:
    """Put the pieces in ``order`` into the bins there are (``loads``: how full each is), opening new ones where none has room."""
    room = Bins(length)
    for number, load in enumerate(loads):
        if 0 < load < length:
            room.put(number, length - load)
    made = len(loads)
    for piece, size in zip(order.tolist(), sizes[order].tolist()):
        found = room.best(size)
        if found is None:
            found = made, length
            made += 1
        bin_of[piece] = found[0]
        if found[1] > size:
            room.put(found[0], found[1] - size)
    return renumbered(bin_of)


def renumbered(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def loads_of(sizes: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=sizes).astype(np.int64) if len(bin_of) else np.zeros(0, np.int64)


def fitness(sizes: np.ndarray, bin_of: np.ndarray, length: int) -> float:
    """Fewer bins are better; of as many, those where full bins stand beside empty ones."""
    loads = loads_of(sizes, bin_of) / length
    return float((loads**2).sum()) - len(loads) * 1e6


def crossed(sizes: np.ndarray, into: np.ndarray, source: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """``into`` with some of the fullest bins of ``source`` set in whole, and without its own bins that hold a piece of them."""
    full = loads_of(sizes, source)
    fullest = np.argsort(-full, kind="stable")[: max(1, len(full) // 2)]
    taken = np.zeros(len(full), bool)
    taken[fullest[rng.random(len(fullest)) < 0.5]] = True
    injected = taken[source]
    emptied = np.zeros(into.max() + 1, bool)
    emptied[into[injected]] = True
    if not injected.any():  # nothing set in: open the emptier bins
        load = loads_of(sizes, into)
        emptied[np.argsort(load, kind="stable")[: max(1, len(load) // 10)]] = True
    displaced = emptied[into] & ~injected
    child = np.where(injected, into.max() + 1 + source, into)
    child[displaced] = -1
    order = np.flatnonzero(displaced)
    kept = renumbered(child)
    if len(order):
        kept -= 1  # the displaced ones were number 0
    loads = loads_of(sizes[kept >= 0], kept[kept >= 0]).tolist()
    return best_fit(sizes, order[np.argsort(-sizes[order], kind="stable")], kept, loads, length)


def first_packing(sizes: np.ndarray, length: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best fit, longest first; with a generator lengths count as up to a tenth less or more for the order."""
    weight = sizes if rng is None else sizes * (1 + 0.2 * (rng.random(len(sizes)) - 0.5))
    return best_fit(sizes, np.argsort(-weight, kind="stable"), np.full(len(sizes), -1, np.int64), [], length)


def perfect(sizes: np.ndarray, bin_of: np.ndarray, length: int) -> bool:
    """No packing needs fewer bins: by the sum of lengths, or because pieces of over half a bin need one each."""
    return bin_of.max(initial=-1) + 1 <= max(-(-int(sizes.sum()) // length), int((2 * sizes > length).sum()))


def evolve(sizes: np.ndarray, packings: list[np.ndarray], length: int, children: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One epoch: children of parents chosen by tournament take the worst packing's place, if they are better. Best first."""
    ranked = sorted(((fitness(sizes, p, length), i, p) for i, p in enumerate(packings)), key=lambda x: (-x[0], x[1]))
    for born in range(children):
        if perfect(sizes, ranked[0][2], length):
            break
        first, second = (min(rng.integers(0, len(ranked), 2)) for _ in range(2))
        child = crossed(sizes, ranked[first][2], ranked[second][2], length, rng)
        worth = fitness(sizes, child, length)
        if worth > ranked[-1][0] and all(worth != r[0] for r in ranked):
            ranked[-1] = (worth, len(packings) + born, child)
            ranked.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in ranked]


STATE = "shard bigint, island int, sizes binary, packings array<binary>, best double, perfect boolean"


def islands_of(shards: DataFrame, length: int, islands: int, packings: int) -> DataFrame:
    """Every shard's islands with their first packings: one by best fit decreasing, the others in shaken order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sizes in zip(batch.column("shard").to_pylist(), batch.column("sizes")):
                sizes = np.array(sizes.values, np.int64)
                plain = first_packing(sizes, length, None)
                done = perfect(sizes, plain, length)
                for island in range(1 if done else islands):
                    rng = np.random.default_rng([int(shard), island])
                    yield _state(shard, island, sizes, [plain] if done else [plain, *(first_packing(sizes, length, rng) for _ in range(packings - 1))], length)

    return shards.select("shard", "sizes").mapInArrow(run, STATE)


def _state(shard: int, island: int, sizes: np.ndarray, packings: list[np.ndarray], length: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.float64(), pa.bool_()]
    row = [shard, island, sizes.astype("<i4").tobytes(), [p.astype("<i4").tobytes() for p in packings], fitness(sizes, packings[0], length), perfect(sizes, packings[0], length)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split(" ")[0] for x in STATE.split(", ")])


def migrated(state: DataFrame, islands: int) -> DataFrame:
    """The best packing of each island takes the place of the last one of the next island of its shard."""
    elite = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("packings")[0].alias("guest"))
    stay = F.slice("packings", F.lit(1), F.size("packings") - 1)
    return state.join(elite.hint("merge"), ["shard", "island"], "left").withColumn(
        "packings", F.when(F.col("guest").isNull() | (F.size("packings") < 2), F.col("packings")).otherwise(F.concat(stay, F.array("guest")))).select(*state.columns)


def epoch(state: DataFrame, number: int, length: int, children: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                rng = np.random.default_rng([row["shard"], row["island"], number])
                yield _state(row["shard"], row["island"], sizes, evolve(sizes, [np.frombuffer(p, "<i4") for p in row["packings"]], length, children, rng), length)

    return state.mapInArrow(run, STATE)


def packed_shards(shards: DataFrame, length: int, islands: int, packings: int, epochs: int, children: int) -> DataFrame:
    """The best packing found for each shard: (shard, bins)."""
    state = materialize(islands_of(shards, length, islands, packings), "islands")
    seen = state
    for number in range(epochs):
        # an island that found a packing as good as any can be ends its shard
        ended = state.where("perfect").select("shard").distinct()
        going = state.join(ended.hint("merge"), "shard", "left_anti")
        if not going.limit(1).count():
            break
        state = materialize(epoch(migrated(going, islands) if number else going, number, length, children), "islands")
        seen = seen.unionByName(state)
    return seen.groupBy("shard").agg(F.max_by(F.col("packings")[0], F.struct("best", -F.col("island"))).alias("bins"))


def placed(shards: DataFrame, bins: DataFrame, level: int, length: int, reopen: bool) -> DataFrame:
    """The pieces of each shard with sequence, place in it, and whether the sequence is filled too badly to stay (``open``)."""
    names = ["sequence_id", "offset", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                held = part.column("held").flatten()
                sizes = np.array(held.field("length"), np.int64)
                bin_of = np.frombuffer(part.column("bins")[0].as_py(), "<i4")
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(bin_of[order], bin_of[order])
                offset = np.empty(len(sizes), np.int64)
                offset[order] = ends - sizes[order] - (ends - sizes[order])[first]
                poor = loads_of(sizes, bin_of) < WELL_FILLED * length
                yield pa.RecordBatch.from_arrays(
                    [*held.flatten(), pa.array((level << 56) + (part.column("shard")[0].as_py() << 24) + bin_of.astype(np.int64)), pa.array(offset), pa.array(poor[bin_of] & reopen)],
                    names=[*(f.name for f in held.type), *names])

    joined = shards.select("shard", "held").join(bins.hint("merge"), "shard")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shards.schema["held"].dataType.elementType.fields)
    return joined.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint, open boolean")


def pack(cut: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, packings: int = PACKINGS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """Give each piece (any columns with ``length`` and a random ``draw``) a ``sequence_id`` and its ``offset`` there."""
    names = [c for c in cut.columns if c != "draw"]
    waiting = materialize(cut, "pieces")
    out, level, shards_before = [], 0, None
    while True:
        n = waiting.count()
        shards = max(1, -(-n // shard))
        # the last level: one shard, or no fewer than before
        last = shards == 1 or shards_before is not None and 2 * shards > shards_before
        dealt = waiting.withColumn("shard", F.pmod(F.xxhash64("draw", F.lit(level)), F.lit(shards)))
        piece = F.struct(*names, "draw")
        grouped = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(piece)).alias("held")).withColumn("sizes", F.col("held.length"))
        grouped = materialize(grouped, "shards")
        done = materialize(placed(grouped, packed_shards(grouped, length, islands, packings, epochs, children), level, length, not last), "placed")
        out.append(done.where("not open"))
        if last:
            break
        waiting, level, shards_before = done.where("open").select(*names, "draw"), level + 1, shards
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.select(*names, "sequence_id", "offset")

"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. A token that ends there (found by an
automaton over all tokens) is that one if the unique last token of the rest before it and the token stand
side by side without a merge across their border. Following the stored tokens back from the end of the word
gives the ids that merging by rank would give, in time linear in the word however long it is.

Defined results: a null text is encoded like an empty one (no ids); null ids are decoded like none. A frame's
other columns are left as they are; an existing column of the output's name is replaced. The tokenizer file is
read by the driver and broadcast (a few MB, fixed by the file).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, worker_state

WORDS = 150_000  # words whose ids are remembered by a worker, in each of two generations
PAIRS = 200_000  # pairs whose compatibility is remembered by a worker
LONGEST = 64  # longer words are encoded anew each time

# Fixed value: the pattern that cuts a text into words before byte-level merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same pattern for texts without characters beyond U+024F, with their letters, numbers and white space written out: twice as fast.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"""


def byte_of_char() -> dict[str, int]:
    """The visible characters by which tokenizer files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pairs(dict):
    """Whether two tokens can stand side by side, by left << 32 | right; remembered."""

    def __init__(self, merges: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], rank: dict[int, int]):
        self.merges, self.parts, self.rank = merges, parts, rank

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = fits = self.apart(pair >> 32, pair & 0xFFFFFFFF, len(self.merges) + 1)
        return fits

    def apart(self, left: int, right: int, before: int) -> bool:
        """No merge across the border of the two tokens is due before the step ``before``.

        Time runs backwards: of the two pieces that touch the border, the one made last is taken apart.
        A pair of pieces exists until one of them goes into a larger piece. That merge comes first if its
        rank is lower, or if ranks are equal and it lies further left.
        """
        while True:
            made = self.merges.get((left, right))
            if made is not None and self.rank[made] < before:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left piece's merge lies further left, so at an equal rank it wins
                before, left = a, self.parts[left][1]
            else:  # the right piece's merge lies further right, so at an equal rank it loses
                before, right = b + 1, self.parts[right][0]


class Words(dict):
    """Ids of words as little-endian 32-bit integers; when full, words not used since the last time are forgotten."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = b"".join(map(self.bpe.packed.__getitem__, self.bpe.word_ids(word.encode())))
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A tokenizer read from the text of its JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only plain merges are supported")
        byte = byte_of_char()
        vocabulary = model["vocab"]
        self.bytes = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items()}
        merges, parts, rank = {}, {}, {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocabulary[a + b]
            merges[vocabulary[a], vocabulary[b]] = made
            parts.setdefault(made, (vocabulary[a], vocabulary[b]))
            rank.setdefault(made, at)
        self.pairs = Pairs(merges, parts, rank)
        self.automaton = ahocorasick.Automaton()
        valid: dict[int, bool] = {}
        for i in sorted(self.bytes, key=lambda i: rank.get(i, -1)):
            if i in parts:  # a token that merging never leaves whole takes no part
                a, b = parts[i]
                valid[i] = valid[a] and valid[b] and self.pairs.apart(a, b, rank[i])
            else:
                valid[i] = len(self.bytes[i]) == 1
            if valid[i]:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.added = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError("only plain added tokens are supported")
            self.added[token["content"]] = token["id"]
            self.bytes[token["id"]] = b"".join(bytes([byte[c]]) if c in byte else c.encode() for c in token["content"])
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.cut_any, self.cut_latin, self.beyond_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall, re.compile("[^\u0000-\u024f]").search
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes}
        self.words = Words(self)

    def cut(self, text: str) -> list[str]:
        """The words of a text; nothing of it is left out."""
        return self.cut_any(text) if self.beyond_latin(text) else self.cut_latin(text)

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: the last token of every prefix, then back-pointers from the end."""
        last, size_of = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0 and (size == end or last[end - size] >= 0 and pairs[last[end - size] << 32 | token]):
                last[end], size_of[end] = token, size
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size_of[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.added_pattern is None or not any(token in text for token in self.added):
            return b"".join(map(self.words.__getitem__, self.cut(text)))
        out = []
        for i, piece in enumerate(self.added_pattern.split(text)):
            out.append(self.packed[self.added[piece]] if i % 2 else b"".join(map(self.words.__getitem__, self.cut(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def tokenizer(text: str) -> Bpe:
    """One tokenizer per worker, with what it remembers."""
    state = worker_state("bpe")
    if state.get("text") != text:
        state.update(text=text, bpe=Bpe(text))
    return state["bpe"]


def load(spark: SparkSession, path: str):
    """The tokenizer file's text as a broadcast variable."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _each(values: pa.Array, make, kind: pa.DataType) -> pa.Array:
    parts = [pa.array(map(make, part.to_pylist()), kind) for part in slices(values)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encoder(spec) -> object:
    """A function of a text column: ids as binary, four bytes each, little-endian."""
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = tokenizer(spec.value)
        return _each(texts, lambda x: bpe.encode(x) if x else b"", pa.binary())
    return encode


def decoder(spec) -> object:
    """A function of a column of ids: the text."""
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = tokenizer(spec.value)
        return _each(ids, lambda x: bpe.decode(x) if x else "", pa.string())
    return decode


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text column, see ``encoder``; added tokens in a text get their own ids."""
    return df.withColumn(ids, encoder(load(df.sparkSession, path))(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a column of ids."""
    return df.withColumn(text, decoder(load(df.sparkSession, path))(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of a text and the text that these ids decode to, in one pass over the rows; results are handed on in small batches.

    ``encode`` followed by ``decode`` gives the same; there, Spark would put the first function into the second and encode twice.
    A text goes to the workers once: Spark holds a batch of rows several times, in its own memory and in theirs.
    """
    spec = load(df.sparkSession, path)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    at = kept.index(text) if text in kept else len(kept)  # where the text is among the columns that are sent
    sent = df.select(*kept) if text in kept else df.select(*kept, F.col(text).alias("_said"))
    schema = T.StructType([*sent.schema.fields[:len(kept)], T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for part in slices(batch):
            own = [bpe.encode(x) if x else b"" for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(own, pa.binary()), pa.array([bpe.decode(x) for x in own], pa.string())],
                                             names=[*kept, ids, decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from coded(batch)
            del batch  # before the next one is read
            pa.default_memory_pool().release_unused()
        worker_state("")  # the task is over: a worker that waits holds no words

    return sent.mapInArrow(run, schema)


def id_count(ids: Column) -> Column:
    return F.coalesce(F.octet_length(ids).cast("long"), F.lit(0)) / 4

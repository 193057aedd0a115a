"""Packing of token ids into rows of fixed length.

Documents are cut into pieces of at most ``length`` ids, so nothing is lost; pieces are packed by best fit decreasing: the longest
first, each into the fullest row that still holds it. The rows' free capacities lie in a segment tree over capacities,
whose search for the least sufficient one takes steps in the logarithm of the length. Pieces are dealt into shards of
about SHARD ids by a number drawn for each piece and written with it, and packed shard by shard: what a task holds does not
grow with the data, however often a key or a text repeats, and a shard wastes at most its last rows. Runs over the same files draw
alike. A document's pieces may go to different shards; each segment says where it belongs.

A packed row is a line of the id matrix: ids (little-endian, 2 or 4 bytes each, padded to the length), the cumulative segment
lengths, the position of each id in its segment (starting anew with every segment; 0 for padding), and per segment
the document, the piece and its offset in the document.

Defined results: null or empty ids make no piece, and such documents no segment; null and repeated keys are packed like others;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, worker_state

LENGTH = 2048
SHARD = 1 << 20
TASKS = 1 << 16  # at most; each packs its shards one after the other
PACKED = ("shard bigint, row int, n_ids int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<bigint>, pieces array<bigint>, offsets array<bigint>")


def token_ids(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", width: int = 4) -> DataFrame:
    """Add the ids of a text by a file of ranks (base64 bytes and rank a line), little-endian, ``width`` (2 or 4) bytes each; null texts have none.

    The file is read by the driver and broadcast (a few MB, fixed by the file).
    """
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast((f.read(), pattern))

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        state = worker_state("ranks")
        if state.get("spec") != spec.value:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.value[0].splitlines())}
            if width == 2 and max(ranks.values()) > 0xFFFF:
                raise ValueError("an id does not fit into 2 bytes")
            state.update(spec=spec.value, encoding=tiktoken.Encoding("ranks", pat_str=spec.value[1], mergeable_ranks=ranks, special_tokens={}))
        own = state["encoding"].encode_ordinary
        return pa.array((np.array(own(x.as_py() or ""), f"<u{width}").tobytes() for x in texts), pa.binary())

    return df.withColumn(ids, encode(F.col(text)))


class Capacities:
    """How many open rows have each free capacity, as sums over a segment tree."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.sums = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free capacity of at least ``need``, and that capacity; it leaves the tree."""
        node, sums = need + self.size, self.sums
        while not sums[node]:  # go right, up to the first sibling that has any
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node + (sums[2 * node] == 0)
        capacity = node - self.size
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.sums[node] += change
            node >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces of each row; sizes descend."""
    free, rows = Capacities(length), []
    for piece, size in enumerate(sizes):
        found = free.take(size)
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        row, capacity = found
        rows[row].append(piece)
        if capacity > size:
            free.put(capacity - size, row)
    return rows


def pack(df: DataFrame, key: str = "doc_id", ids: str = "ids", length: int = LENGTH, id_bytes: int = 4, width: int = 2, shard_ids: int = SHARD, pad: int = 0) -> DataFrame:
    """The packed rows of a frame with token ids as little-endian integers of ``id_bytes`` bytes (binary). ``width``: bytes of an id in the output."""
    if width not in (2, 4) or id_bytes not in (2, 4):
        raise ValueError("ids have 2 or 4 bytes")
    given, kind = np.dtype(f"<u{id_bytes}"), np.dtype(f"<u{width}")
    size = length * id_bytes
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids"))
    # no filter on the ids: if a function makes them, it would run once for the filter and once for the rows
    numbers = F.when(F.octet_length("ids") > 0, F.sequence(F.lit(0), F.floor((F.octet_length("ids") - 1) / size)))
    cut = rows.withColumn("piece", F.explode(numbers))
    data = F.substring(F.col("ids"), (F.col("piece") * size + 1).cast("int"), F.lit(size))
    # the number of shards needs a first look at all pieces; a draw that is written is the same in every later attempt
    pieces = materialize(cut.select("key", "piece", data.alias("data"), (F.rand(11) * (1 << 31)).cast("int").alias("draw")), "pieces")
    total = pieces.agg(F.sum(F.octet_length("data"))).head()[0] or 0
    shards = max(1, -(-total // (id_bytes * shard_ids)))
    tasks = min(shards, TASKS)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards))).drop("draw")

    def written(data: bytes) -> bytes:
        if given == kind:
            return data
        values = np.frombuffer(data, given)
        if values.max() > np.iinfo(kind).max:
            raise ValueError("an id does not fit into 2 bytes")
        return values.astype(kind).tobytes()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for own, k, p, data in zip(*(batch[c].to_pylist() for c in ("shard", "key", "piece", "data"))):
                if own != shard and held:
                    yield from _packed(shard, held, length, kind, pad)
                    held = []
                shard = own
                held.append((k, p, written(data)))
        if held:
            yield from _packed(shard, held, length, kind, pad)

    alone = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return alone.sortWithinPartitions("shard", "key", "piece", "data").mapInArrow(fill, PACKED)


def _packed(shard: int, pieces: list[tuple[int | None, int, bytes]], length: int, kind: np.dtype, pad: int) -> Iterator[pa.RecordBatch]:
    pieces = sorted(pieces, key=lambda x: -len(x[2]))  # stable: equal lengths stay in key order
    sizes = [len(x[2]) // kind.itemsize for x in pieces]
    out: list[dict] = []
    for row, own in enumerate(best_fit(sizes, length)):
        ends = np.cumsum([sizes[i] for i in own]).tolist()
        positions = np.zeros(length, "<u4")
        for i, end in zip(own, ends):
            positions[end - sizes[i] : end] = np.arange(sizes[i])
        filling = np.full(length - ends[-1], pad, kind).tobytes()
        out.append({"shard": shard, "row": row, "n_ids": ends[-1], "n_segments": len(own), "ids": b"".join(pieces[i][2] for i in own) + filling,
                    "cu_seqlens": [0, *ends], "positions": positions.astype("<u2" if length <= 1 << 16 else "<u4").tobytes(),
                    "doc_ids": [pieces[i][0] for i in own], "pieces": [pieces[i][1] for i in own], "offsets": [pieces[i][1] * length for i in own]})
        if len(out) == 1024:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    of = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, of[t]) for n, t in (x.split(" ") for x in PACKED.split(", "))]))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; every row has all that is needed to train on it."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_packed`` wrote."""
    return spark.read.schema(PACKED).parquet(path)

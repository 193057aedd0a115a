"""Links between near-equal texts, found without gathering or listing all pairs of a crowd.

Texts with the same words in the same order are one node (its copies are counted, never paired). Nodes whose MinHash values
agree in a band meet in that band's bucket. A bucket of any size is cut into tiles, each the pairs of two chunks of at most
CHUNK nodes, so no task holds a whole bucket; a pair is looked at only in the first band it agrees in. Pairs that pass
the test given make a graph, of which a tile passes on a spanning forest only. Each connected part of it is again cut into
tiles, in which the exact Jaccard similarities of all pairs are computed as one matrix product over the shared
shingles; a tile passes on the number of links of each node and a spanning forest. So what moves grows
with the nodes and tiles, not with the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices
from .shingles import SIZE, MinHash, blocks, shingle_hashes

CHUNK = 512  # nodes of a chunk, at most
CHUNK_SHINGLES = 1 << 18  # shingles of a chunk, about
COLUMNS = 1 << 12  # shared shingles multiplied at a time
PAIRS = 1 << 15  # pairs compared at a time: two signatures each

Survive = Callable[[np.ndarray, np.ndarray], np.ndarray]


def node_of(text: bytes) -> bytes:
    """16 bytes that stand for the sequence of words."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def signed(df: DataFrame, key: str, text: str, permutations: int, size: int = SIZE) -> DataFrame:
    """id (the key), row (the key or, where it is null, a number fixed by the text), said (a digest of the text), node, shingles (their
    number), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(permutations, size)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [x.encode() for x in batch["text"].to_pylist()]
            values, counts = [], []
            for i, j in blocks(texts):
                shingles, n = shingle_hashes(texts[i:j], size)
                values += [x.tobytes() for x in hasher.of_shingles(shingles, n)]
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], batch["said"], pa.array([node_of(x) for x in texts], pa.binary()), pa.array(counts, pa.int64()),
                                              pa.array(values, pa.binary())], names=["id", "row", "said", "node", "shingles", "signature"])

    return _rows(df, key, text).mapInArrow(run, "id bigint, row bigint, said binary, node binary, shingles bigint, signature binary")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    said = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(key).cast("bigint"), F.xxhash64(said)).alias("row"),
                     digest_of(text).alias("said"), said.alias("text"))


def digest_of(text: str) -> Column:
    """16 bytes that stand for the exact text, made without Python: a key may stand for very many texts."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _tiles(members: DataFrame, group: list[str], chunks: Column, by: Column, fields: list[str]) -> DataFrame:
    """Members of a group, dealt into chunks, meet in tiles (low chunk, high chunk): group, low, high, members with ``high_side``.

    In a tile of two chunks both are kept apart; in one of a single chunk all members are on the low side.
    """
    dealt = members.withColumns({"chunks": chunks}).withColumn("chunk", F.pmod(by, F.col("chunks")))
    met = dealt.select(*group, *fields, "chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("other"))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    member = F.struct((F.col("chunk") > F.col("other")).alias("high_side"), *fields)
    return met.groupBy(*group, low.alias("low"), high.alias("high")).agg(F.collect_list(member).alias("members"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest number of the connected part of each of n nodes."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def candidates(nodes: DataFrame, rows: int, bands: int, survive: Survive | None) -> DataFrame:
    """A spanning forest (a, b) of the pairs of nodes that agree in a band and pass ``survive``.

    ``survive`` takes the signatures of both sides of many pairs and says which go on; None lets all pass.
    """
    wide = 2 * rows  # bytes of a band
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * wide + 1, F.lit(wide))))
    full = nodes.where("shingles > 0")
    spread = full.select("node", F.posexplode(band).alias("band", "bucket"))
    shared = spread.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    # frames that grow with the rows are joined by sorting at every size
    members = spread.join(shared.hint("merge"), ["band", "bucket"]).join(full.select("node", "signature").hint("merge"), "node")
    # a chunk's place is drawn anew in every bucket: the nodes of one crowd do not always meet the same neighbours
    tiles = _tiles(members, ["band", "bucket"], F.ceil(F.col("n") / CHUNK), F.xxhash64("node"), ["node", "signature"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for band, low, high, members in zip(batch["band"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), batch["members"]):
                held.append((band, low, high, members.as_py()))
                size += len(members) ** 2 // 2
                if size > PAIRS:
                    yield _forest(held, rows, survive)
                    held, size = [], 0
            if held:
                yield _forest(held, rows, survive)

    return tiles.select("band", "low", "high", "members").mapInArrow(run, "a binary, b binary")


def _forest(tiles: list[tuple], rows: int, survive: Survive | None) -> pa.RecordBatch:
    """A spanning forest of the surviving pairs of several tiles."""
    names, signatures, left, right, bands = [], [], [], [], []
    for band, low, high, members in tiles:
        members = sorted({(m["high_side"], bytes(m["node"]), bytes(m["signature"])) for m in members})
        at, first = len(names), sum(not m[0] for m in members)
        names += [m[1] for m in members]
        signatures += [m[2] for m in members]
        n = len(members)
        i, j = np.triu_indices(n, 1) if low == high else (x.ravel() for x in np.mgrid[:first, first:n])
        left.append(i + at)
        right.append(j + at)
        bands.append(np.full(len(i), band))
    values = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(names), -1)
    left, right, bands = map(np.concatenate, (left, right, bands))
    keep_left, keep_right = [], []
    for at in range(0, len(left), PAIRS):
        i, j, band = left[at : at + PAIRS], right[at : at + PAIRS], bands[at : at + PAIRS]
        if survive is not None:
            alive = survive(values[i], values[j])
            i, j, band = i[alive], j[alive], band[alive]
        # only in the first band in which the two agree
        cut = values.shape[1] // rows * rows
        agree = (values[i, :cut] == values[j, :cut]).reshape(len(i), cut // rows, rows).all(2)
        first = (agree.argmax(1) == band) & agree.any(1)
        keep_left.append(i[first])
        keep_right.append(j[first])
    order = {name: k for k, name in enumerate(sorted(set(names)))}
    number = np.array([order[name] for name in names])
    known = sorted(order)
    root = _roots(len(known), number[np.concatenate(keep_left)], number[np.concatenate(keep_right)])
    hung = np.flatnonzero(root != np.arange(len(known)))
    return pa.RecordBatch.from_arrays([pa.array([known[x] for x in hung], pa.binary()), pa.array([known[x] for x in root[hung]], pa.binary())], names=["a", "b"])


def parts(edges: DataFrame) -> DataFrame:
    """node, root: the connected parts of a graph given by its edges (a, b), each part named by its lowest node.

    Every round hangs each node below its lowest neighbour, follows the pointers to the top, and goes on with the edges between
    tops. Sums of a node's edges are combined before the shuffle, so a node with very many costs no more.
    """
    top = None
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        low = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("low"))
        hung = materialize(low.select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "hung")
        while True:
            up = hung.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
            stepped = materialize(hung.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "stepped")
            hung = stepped.select("node", "root")
            if stepped.where("moved").isEmpty():
                break
        if top is None:
            top = hung
        else:
            further = hung.select(F.col("node").alias("root"), F.col("root").alias("next"))
            top = materialize(top.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "top")
        name = hung.select(F.col("node").alias("a"), F.col("root").alias("x")), hung.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = materialize(edges.join(name[0], "a").join(name[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if top is None else top


def _verify(sides: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, single: bool, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member in a tile (in copies), and the lowest member of its connected part."""
    n, counts = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), counts)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - start] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    union = counts[:, None] + counts[None, :] - common
    linked = common * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(linked, False)
    if not single:
        linked &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(np.triu(linked))
    return linked @ copies, _roots(n, a, b)


def verified(spark: SparkSession, df: DataFrame, key: str, text: str, nodes: DataFrame, forest: DataFrame, threshold: Fraction, size: int = SIZE) -> DataFrame:
    """node, links (how many rows its links lead to) and root, for nodes with a link, all links checked exactly."""
    part = parts(forest)
    own = part.hint("merge").join(nodes, "node").select("node", "root", "row", "said", "copies", "shingles")
    total = own.groupBy("root").agg(F.count("*").alias("n"), F.sum("shingles").alias("total"))
    wanted = own.join(total, "root").select("node", "root", "row", "said", "copies", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES)).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    # repeated rows meet map-side, and the shuffle that removes them is the join's
    texts = _rows(df, key, text).select("row", "said", "text").dropDuplicates(["row", "said"])
    found = texts.join(wanted.hint("merge"), ["row", "said"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [x.encode() for x in batch["text"].to_pylist()]
            own = []
            for i, j in blocks(texts):
                values, counts = shingle_hashes(texts[i:j], size)
                own += [np.unique(x).tobytes() for x in np.split(values, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["root"], batch["copies"], batch["wanted"], pa.array(own, pa.binary())],
                                             names=["node", "root", "copies", "wanted", "set"])

    sets = found.mapInArrow(shingled, "node binary, root binary, copies bigint, wanted bigint, set binary")
    tiles = _tiles(sets, ["root"], F.col("wanted"), F.xxhash64("node"), ["node", "copies", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for low, high, members in zip(batch["low"].to_pylist(), batch["high"].to_pylist(), batch["members"]):
                seen = {bytes(m["node"]): m for m in members.as_py()}
                names = sorted(seen)
                if len(names) < 2:
                    continue
                links, root = _verify(np.array([seen[x]["high_side"] for x in names]), [np.frombuffer(seen[x]["set"], np.uint64) for x in names],
                                      np.array([seen[x]["copies"] for x in names]), low == high, threshold)
                for k in np.flatnonzero(links):
                    out[0].append(names[k])
                    out[1].append(int(links[k]))
                    out[2].append(names[root[k]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["node", "links", "root"])

    seen = materialize(tiles.select("low", "high", "members").mapInArrow(check, "node binary, links bigint, root binary"), "seen")
    sums = seen.groupBy("node").agg(F.sum("links").alias("links"))
    joined = parts(seen.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return sums.join(joined, "node")


def classes(df: DataFrame, key: str, text: str, rows: int, bands: int, threshold: Fraction, survive: Survive | None, size: int = SIZE) -> DataFrame:
    """id, row, said, node, root, class_row, class_id, n_copies, n_links for every row of df.

    Texts are linked if the Jaccard similarity of their shingle sets reaches the threshold; a class is a connected part. root names it; class_id is
    the lowest key in it (null if no member has one), class_row the lowest row number; n_copies counts the other
    rows with the same words, n_links the other rows linked, copies included. Texts without words are copies of each other.
    """
    spark = df.sparkSession
    each = materialize(signed(df, key, text, rows * bands, size), "signed")
    nodes = materialize(each.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("row", "said")).alias("at"), F.count("*").alias("copies"),
                                                 F.first("shingles").alias("shingles"), F.first("signature").alias("signature"))
                        .select("node", "id", "at.row", "at.said", "copies", "shingles", "signature"), "nodes")
    linked = verified(spark, df, key, text, nodes, candidates(nodes, rows, bands, survive), threshold, size)
    named = nodes.select("node", "id", "row", "copies").join(linked.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    lowest = named.groupBy("root").agg(F.min("id").alias("class_id"), F.min("row").alias("class_row"))
    facts = named.join(lowest, "root").select("node", "root", "class_id", "class_row", (F.col("copies") - 1).alias("n_copies"),
                                              (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return each.select("id", "row", "said", "node").join(facts.hint("merge"), "node")
